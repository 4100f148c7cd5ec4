"""Pixel, descriptor and region distances; colour, size and level rules: Column in, Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def l1_colour(a: list[Column], b: list[Column]) -> Column:
    """Mean absolute difference of three channels."""
    return total([F.abs(x - y) for x, y in zip(a, b)]) / 3.0


def l2_colour(a: list[Column], b: list[Column]) -> Column:
    """Root mean square difference of three channels."""
    return F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b)]) / 3.0)


def l2_gradient(a: list[Column], b: list[Column]) -> Column:
    return F.least(F.lit(1.0), 10.0 * F.sqrt(total([(x - y) * (x - y) for x, y in zip(a, b)]) / 2.0))


def l1_gradient(a: list[Column], b: list[Column]) -> Column:
    return total([F.abs(x - y) for x, y in zip(a, b)]) / 2.0


def linear(a: Column, b: Column, wa: float = 0.5, wb: float = 0.5) -> Column:
    return wa * a + wb * b


def independent(a: Column, b: Column) -> Column:
    return 1.0 - (1.0 - a) * (1.0 - b)


def root(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b) * 0.70711


def colour_mean_distance(a: list[Column], b: list[Column], weight: Column, force: float = 0.001) -> Column:
    """L2 distance of means, 0 where the edge is nearly free and the means are close."""
    d = l2_colour(a, b)
    return F.when((weight < force) & (d < 0.2), F.lit(0.0)).otherwise(d)


def mean_variance_distance(a: list[Column], b: list[Column], variance: list[Column]) -> Column:
    return F.least(F.lit(1.0), 0.2 * F.sqrt(total([(x - y) * (x - y) / F.greatest(F.lit(1e-4), v) for x, y, v in zip(a, b, variance)])))


def norm_angle(x: Column, y: Column) -> Column:
    """Angle of a vector in [0, 1)."""
    return F.atan2(y, x) / (2.0 * 3.141592653589793 + 1e-4) + 0.5


def gain_change(anchor: Column, mean: Column) -> Column:
    return anchor / (mean + 1e-3)


def squared_or(distances: list[Column]) -> Column:
    """(1 - prod(1 - d))^2."""
    miss = 1.0 - reduce(lambda a, b: a * b, [1.0 - d for d in distances])
    return miss * miss


def size_penalty(small: Column, median: Column, p: float = 0.25) -> Column:
    """min(1, 1 + p log2(smaller size / median)); may be negative."""
    return F.least(F.lit(1.0), 1.0 + p * F.log2(small / median))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def twist(v: Column, weight: float, offset: float) -> Column:
    """Truncated, clamped linear map of an 8-bit channel."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * weight + offset)).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def align(x: Column, to: int = 4) -> Column:
    return (F.ceil(x / float(to)) * to).cast("int")


def sane_fps(fps: Column) -> Column:
    return F.greatest(F.lit(5.0), F.least(F.lit(60.0), F.when(F.isnan(fps), F.lit(24.0)).otherwise(fps)))


def downscale(w: Column, h: Column, scale: Column) -> tuple[Column, Column]:
    """Scaled size, never larger, with an even width."""
    s = F.least(F.lit(1.0), scale)
    even = F.ceil(w * s).cast("int")
    return even + even % 2, F.ceil(h * s).cast("int")


def to_fraction(x: Column, fraction: int) -> Column:
    """Multiple of a fraction: down if the remainder is under half of it, else up."""
    rest = F.pmod(x, F.lit(fraction))
    return F.when(rest < F.expr(f"{fraction} div 2"), x - rest).otherwise(x - rest + fraction)


# Channels of each pixel format.
CHANNELS = {"RGB24": 3, "BGR24": 3, "ARGB32": 4, "ABGR32": 4, "RGBA32": 4, "BGRA32": 4, "YUV422": 2, "LUMINANCE": 1}


def channels(fmt: Column) -> Column:
    return F.coalesce(*[F.when(fmt == k, F.lit(v)) for k, v in CHANNELS.items()])


def level_rules(level: Column, n: Column) -> dict[str, Column]:
    """Four ways to turn a fractional level into an index: converter, renderer, unit, viewer."""
    part = (level * n).cast("int")
    return {
        "converter": F.when((level == 0) | (level >= 1), level.cast("int")).otherwise(part),
        "renderer": part,
        "unit": F.least(n - 1, F.when(level == F.floor(level), level.cast("int")).otherwise(part)),
        "viewer": (level * (n - 1)).cast("int"),
    }


def random_terms(k: int) -> tuple[list[int], list[int]]:
    """The C library's ``rand`` after ``srand(seed)`` as sums: its k-th value is half the sum
    of term x (start x seed mod 2^31 - 1), mod 2^32. Additive feedback over 31 words, lags 3
    and 31, the first 310 values thrown away: linear, so that only 31 factors are left."""
    start = [1]
    while len(start) < 31:
        start.append(start[-1] * 16807 % ((1 << 31) - 1))
    rows = [[int(i == j) for j in range(31)] for i in range(31)] + [[int(i == j) for j in range(31)] for i in range(3)]
    while len(rows) <= 344 + k:
        rows.append([(a + b) % (1 << 32) for a, b in zip(rows[-3], rows[-31])])
    return start, rows[344 + k]


def random_value(seed: Column, k: int = 0) -> Column:
    """k-th value of the C library's generator for a seed of up to 31 bits; 0 counts as 1."""
    start, terms = random_terms(k)
    s = F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long")
    low = F.lit((1 << 32) - 1)
    parts = [(s * F.lit(a) % F.lit((1 << 31) - 1) * F.lit(b)).bitwiseAND(low) for a, b in zip(start, terms) if b]
    return F.shiftright(total(parts).bitwiseAND(low), 1)


def region_colour(seed: Column, channels: int = 3) -> list[Column]:
    """Colour of a region by its id: consecutive random values below 255."""
    return [(random_value(seed, c) % 255).cast("int") for c in range(channels)]
