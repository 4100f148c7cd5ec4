"""Mergeable region descriptors in long form: (key..., bin, value, weight_sum)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.pixel import total


def colour_bin(c: list[Column], lum: int, col: int) -> Column:
    """Bin of an 8-bit pixel in a lum x col x col histogram."""
    return F.shiftright(c[0] * lum, 8) * (col * col) + F.shiftright(c[1] * col, 8) * col + F.shiftright(c[2] * col, 8)


def corners(c: list[Column], bins: tuple[int, int, int]) -> Column:
    """Trilinear split of a pixel in [0, 1]^3: array of (bin, weight) over eight corners.

    A coordinate c in an axis of n bins lies at c (n - 1) between two bin centres.
    """
    at = [x * float(n - 1) for x, n in zip(c, bins)]
    low = [F.least(F.floor(a), F.lit(n - 2)).cast("int") for a, n in zip(at, bins)]
    part = [a - l for a, l in zip(at, low)]
    out = []
    for k in range(8):
        bits = [(k >> j) & 1 for j in range(3)]
        idx = [l + b for l, b in zip(low, bits)]
        w = [p if b else 1.0 - p for p, b in zip(part, bits)]
        out.append(F.struct(((idx[0] * bins[1] + idx[1]) * bins[2] + idx[2]).alias("bin"), (w[0] * w[1] * w[2]).alias("w")))
    return F.array(*out)


def _axes(bins: tuple[int, int, int]) -> list[Column]:
    return [F.floor(F.col("bin") / (bins[1] * bins[2])), F.floor(F.col("bin") / bins[2]) % bins[1], F.col("bin") % bins[2]]


def scale(hist: DataFrame, keys: list[str], bins: tuple[int, int, int], gain: tuple[float, float, float]) -> DataFrame:
    """Histogram with each axis stretched by its gain, values shared among the bins around."""
    at = [F.least(F.lit(float(n - 1)), i * float(g)) for i, n, g in zip(_axes(bins), bins, gain)]
    cells = hist.select(*keys, "value", F.explode(corners([a / float(n - 1) for a, n in zip(at, bins)], bins)).alias("o"))
    return cells.groupBy(*keys, F.col("o.bin").cast("int").alias("bin")).agg(F.sum(F.col("value") * F.col("o.w")).alias("value")).filter("value <> 0")


def moments(hist: DataFrame, keys: list[str], bins: tuple[int, int, int]) -> DataFrame:
    """Mean and variance of the bin index along each axis of a normalised histogram."""
    named = hist.select(*keys, "value", *[i.cast("double").alias(f"i{k}") for k, i in enumerate(_axes(bins))])
    mean = [F.sum(F.col(f"i{k}") * F.col("value")) for k in range(3)]
    return named.groupBy(*keys).agg(*[c for k in range(3) for c in (mean[k].alias(f"mean{k}"), (F.sum(F.col(f"i{k}") * F.col(f"i{k}") * F.col("value")) - mean[k] * mean[k]).alias(f"var{k}"))])


def spread(rows: DataFrame, at: str, value: Column, bins: int, keys: list[str]) -> DataFrame:
    """Circular histogram in which a value goes to the bins whose centres lie within one bin
    of its place ``at``, by nearness."""
    low = F.floor(at)
    cells = rows.select(*keys, F.col(at).alias("a"), value.alias("m"), F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("k"), low.alias("l"))
    far = F.abs(F.col("l") + F.col("k") + 0.5 - F.col("a"))
    return cells.filter(far < 1.0).groupBy(*keys, F.pmod(F.col("l") + F.col("k"), F.lit(bins)).cast("int").alias("bin")).agg(F.sum((1.0 - far) * F.col("m")).alias("value"))


def between(rows: DataFrame, at: str, bins: int, keys: list[str]) -> DataFrame:
    """Circular histogram in which a place ``at`` is counted in its bin and the next one."""
    cells = rows.select(*keys, F.floor(at).alias("l"), (F.col(at) - F.floor(at)).alias("part"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return cells.groupBy(*keys, F.pmod(F.col("l") + F.col("k"), F.lit(bins)).cast("int").alias("bin")).agg(F.sum(F.when(F.col("k") == 1, F.col("part")).otherwise(1.0 - F.col("part"))).alias("value"))


def _added(a: str, b: str, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def vector_l2(a: str, b: str) -> Column:
    return F.sqrt(_added(a, b, lambda x, y: (x - y) * (x - y)))


def vector_chi_square(a: str, b: str) -> Column:
    """Half the sum of squared differences over sums; bins empty on both sides add nothing."""
    return 0.5 * _added(a, b, lambda x, y: F.coalesce(F.try_divide((x - y) * (x - y), x + y), F.lit(0.0)))


def normalise(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Bins divided by the added weight, zero bins dropped."""
    weight = hist.groupBy(*keys).agg(F.sum("value").alias("weight_sum"))
    return hist.filter("value <> 0").join(weight, keys).withColumn("value", F.col("value") / F.col("weight_sum"))


def merge_histograms(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Average of normalised histograms weighted by weight_sum, per bin and key. ``hist``
    has a ``part`` column that tells the merged ones apart."""
    weight = hist.select(*keys, "part", "weight_sum").distinct().groupBy(*keys).agg(F.sum("weight_sum").alias("total"))
    raw = hist.groupBy(*keys, "bin").agg(F.sum(F.col("value") * F.col("weight_sum")).alias("raw"))
    return raw.join(weight, keys).select(*keys, "bin", (F.col("raw") / F.col("total")).alias("value"), F.col("total").alias("weight_sum"))


def paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Bins of two histograms side by side, absent ones as 0."""
    return a.select(*on, F.col("value").alias("a")).join(b.select(*on, F.col("value").alias("b")), on, "full_outer").select(
        *on, F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))


def distances() -> dict[str, Column]:
    """Aggregates over columns a, b: chi square, symmetrised KL, JS, L2."""
    a, b = F.col("a"), F.col("b")
    ea, eb = a + 1e-10, b + 1e-10
    m = (ea + eb) / 2.0
    return {
        "chi_square": 0.5 * F.sum(F.when(F.abs(a + b) > 1e-12, (a - b) * (a - b) / F.nullif(a + b, F.lit(0.0))).otherwise(0.0)),
        "kl": 0.5 * F.sum(ea * F.ln(ea / eb) + eb * F.ln(eb / ea)),
        "js": 0.5 * F.sum(ea * F.ln(ea / m) + eb * F.ln(eb / m)),
        "l2": F.sqrt(F.sum((a - b) * (a - b))),
    }


def pooled(df: DataFrame, keys: list[str], n: str, mean: str, var: str) -> DataFrame:
    """Size-weighted mean and pooled variance."""
    s = F.sum(n)
    m = F.sum(F.col(n) * F.col(mean)) / s
    return df.groupBy(*keys).agg(s.alias("n"), m.alias("mean"), (F.sum(F.col(n) * (F.col(var) + F.col(mean) * F.col(mean))) / s - m * m).alias("var"))


__all__ = ["between", "moments", "scale", "spread", "vector_chi_square", "vector_l2", "colour_bin", "corners", "distances", "merge_histograms", "normalise", "paired", "pooled", "total"]
