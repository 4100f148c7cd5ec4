"""Interval (run-length) rasters: encode, merge, measure, look up, paint.

An interval is (frame, region_id, y, left_x, right_x), both ends inclusive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("frame", "region_id", "y")


def run_lengths(labels: DataFrame, value: str = "region_id") -> DataFrame:
    """Maximal runs of equal labels along x in each row of each frame."""
    w = Window.partitionBy("frame", "y").orderBy("x")
    new = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    runs = labels.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("frame", "y", "_r").agg(F.first(value).alias(value), F.min("x").alias("left_x"), F.max("x").alias("right_x")).select(
        "frame", value, "y", "left_x", "right_x")


def coalesce_adjacent(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Join intervals of a row that touch (right + 1 == next left)."""
    w = Window.partitionBy(*keys).orderBy("left_x", "right_x")
    new = F.when(F.lag("right_x").over(w) + 1 == F.col("left_x"), 0).otherwise(1)
    runs = intervals.withColumn("_n", new).withColumn("_r", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_r").agg(F.min("left_x").alias("left_x"), F.max("right_x").alias("right_x")).drop("_r")


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two rasters with touching intervals joined. Rows that only one side has
    are copied as they are."""
    both = a.select(*keys, "left_x", "right_x", F.lit(1).alias("_s")).unionByName(b.select(*keys, "left_x", "right_x", F.lit(2).alias("_s")))
    w = Window.partitionBy(*keys)
    sided = both.withColumn("_one", F.min("_s").over(w) == F.max("_s").over(w))
    joined = coalesce_adjacent(sided.filter(~F.col("_one")), keys)
    return joined.unionByName(sided.filter("_one").select(*keys, "left_x", "right_x"))


def width() -> Column:
    return F.col("right_x") - F.col("left_x") + 1


def area(intervals: DataFrame, keys: list[str]) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.sum(width()).cast("long").alias("area"))


def _squares(n: Column) -> Column:
    """1^2 + ... + n^2."""
    return n * (n + 1) * (2 * n + 1) / 6.0


def moments(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Size, mean and raw second moments per group, from closed forms per interval."""
    l, r, y = (F.col(c).cast("double") for c in ("left_x", "right_x", "y"))
    n = r - l + 1.0
    sx = n * (l + r) / 2.0
    sxx = _squares(r) - _squares(l - 1.0)
    s = F.sum(n)
    return intervals.groupBy(*keys).agg(
        s.alias("size"), (F.sum(sx) / s).alias("mean_x"), (F.sum(n * y) / s).alias("mean_y"),
        (F.sum(sxx) / s).alias("moment_xx"), (F.sum(sx * y) / s).alias("moment_xy"), (F.sum(n * y * y) / s).alias("moment_yy"))


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Size-weighted merge of shape moments."""
    s = F.sum("size")
    mean = lambda c: (F.sum(F.col("size") * F.col(c)) / s).alias(c)
    return parts.groupBy(*keys).agg(s.alias("size"), *[mean(c) for c in ("mean_x", "mean_y", "moment_xx", "moment_xy", "moment_yy")])


def shape(moments_df: DataFrame) -> DataFrame:
    """Centre, axis magnitudes and directions of the covariance of each row.

    ``valid`` is false for an area under 10 or a smaller eigenvalue under 1; the axes are
    the coordinate axes where the discriminant is at most 0.1.
    """
    vx = F.col("moment_xx") - F.col("mean_x") * F.col("mean_x")
    vy = F.col("moment_yy") - F.col("mean_y") * F.col("mean_y")
    cxy = F.col("moment_xy") - F.col("mean_x") * F.col("mean_y")
    df = moments_df.withColumns({"_vx": vx, "_vy": vy, "_c": cxy})
    half = (F.col("_vx") + F.col("_vy")) / 2.0
    disc = F.sqrt(F.greatest(F.lit(0.0), (F.col("_vx") - F.col("_vy")) * (F.col("_vx") - F.col("_vy")) / 4.0 + F.col("_c") * F.col("_c")))
    df = df.withColumns({"_h": half, "_d": disc}).withColumns({"_e1": F.col("_h") + F.col("_d"), "_e2": F.col("_h") - F.col("_d")})
    # Eigenvector of e1: (e1 - vy, c), or (c, e1 - vx) where the first is shorter.
    a, b = F.col("_e1") - F.col("_vy"), F.col("_e1") - F.col("_vx")
    dx, dy = F.when(F.abs(a) >= F.abs(b), a).otherwise(F.col("_c")), F.when(F.abs(a) >= F.abs(b), F.col("_c")).otherwise(b)
    df = df.withColumns({"_dx": dx, "_dy": dy}).withColumn("_n", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))
    plain = F.col("_d") <= 0.1
    major = lambda c, unit: F.when(plain, F.lit(unit)).otherwise(F.try_divide(F.col(c), F.col("_n")))
    out = df.withColumns({
        "center_x": F.col("mean_x"), "center_y": F.col("mean_y"),
        "mag_major": F.sqrt(F.greatest(F.lit(0.0), F.when(plain, F.col("_vx")).otherwise(F.col("_e1")))),
        "mag_minor": F.sqrt(F.greatest(F.lit(0.0), F.when(plain, F.col("_vy")).otherwise(F.col("_e2")))),
        "dir_major_x": major("_dx", 1.0), "dir_major_y": major("_dy", 0.0),
        "valid": (F.col("size") >= 10) & (F.col("_e2") >= 1.0),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def at_points(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Region of each point (frame, y, x), -1 if none. An equi-join on the row, then the
    range test."""
    on = (F.col("p.frame") == F.col("i.frame")) & (F.col("p.y") == F.col("i.y")) & F.col("p.x").between(F.col("i.left_x"), F.col("i.right_x"))
    return points.alias("p").join(intervals.alias("i"), on, "left").select("p.*", F.coalesce("i.region_id", F.lit(-1)).alias("region_id"))


def pixels(intervals: DataFrame) -> DataFrame:
    """One row per covered pixel."""
    return intervals.select("frame", "region_id", "y", F.explode(F.sequence("left_x", "right_x")).alias("x"))


def boundary(pixels_df: DataFrame, inner: bool = True) -> DataFrame:
    """N4 boundary per (frame, region): region pixels next to a pixel outside the region,
    or the outside pixels next to the region."""
    keys = ["frame", "region_id", "y", "x"]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    near = pixels_df.withColumn("_o", steps).select("frame", "region_id", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    if not inner:
        return near.join(pixels_df.select(*keys), keys, "left_anti").distinct()
    count = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return pixels_df.select(*keys).join(count, keys, "left").filter(F.coalesce("n", F.lit(0)) < 4).select(*keys)


def touching(a: str, b: str, n8: bool) -> Column:
    """Whether intervals of neighbouring rows touch: they overlap in x (N4), or leave no
    gap when diagonals count (N8)."""
    gap = 1 if n8 else 0
    return (F.col(f"{a}.left_x") <= F.col(f"{b}.right_x") + gap) & (F.col(f"{b}.left_x") <= F.col(f"{a}.right_x") + gap)


def _frame_components(n8: bool):
    """Smallest node of each component of touching intervals of one region in a frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "left_x"])
        rows = list(zip(*(pdf[c].tolist() for c in ("y", "region_id", "left_x", "right_x", "node"))))
        up = list(range(len(rows)))

        def find(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        gap, above, current = int(n8), [], []
        for k, (y, region, left, right, _) in enumerate(rows):
            if current and rows[current[-1]][0] != y:
                above, current = (current if rows[current[-1]][0] == y - 1 else []), []
            beside = [current[-1]] if n8 and current and rows[current[-1]][3] + 1 == left else []
            for j in above + beside:
                if rows[j][1] == region and (j in beside or rows[j][2] <= right + gap and left <= rows[j][3] + gap):
                    a, b = find(j), find(k)
                    up[max(a, b)] = min(a, b)
            current.append(k)
        low: dict[int, int] = {}
        for k, row in enumerate(rows):
            r = find(k)
            low[r] = min(low.get(r, row[4]), row[4])
        return pd.DataFrame({"node": [r[4] for r in rows], "rep": [low[find(k)] for k in range(len(rows))]})

    return run


def components(intervals: DataFrame, n8: bool) -> DataFrame:
    """(node, rep): links of intervals never leave a frame, so each frame is labelled by
    itself, in one pass over its rows; N8 also joins intervals that follow in a row."""
    return intervals.groupBy("frame").applyInPandas(_frame_components(n8), "node long, rep long")
