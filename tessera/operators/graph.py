"""Voxel and region graphs: neighbour edges, buckets, neighbour sets, components."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 2048
# Fixed values: (dy, dx) in the order in which a pixel adds its edges.
SPATIAL = ((0, 1), (1, 0), (1, -1), (1, 1))
TEMPORAL = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))


def node_id(width: int, height: int, frame="frame", y="y", x="x") -> Column:
    return (F.col(frame).cast("long") * (width * height) + F.col(y) * width + F.col(x)).cast("long")


def _offsets(steps) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for i, (a, b) in enumerate(steps)]))


def _pairs(voxels: DataFrame, moved: DataFrame, width: int, height: int, cols: list[str]) -> DataFrame:
    """Join displaced pixels with the pixels they land on."""
    other = voxels.select(F.col("frame").alias("tf"), F.col("y").alias("ty"), F.col("x").alias("tx"), *[F.col(c).alias(f"d_{c}") for c in cols])
    return moved.join(other, ["tf", "ty", "tx"]).withColumns({"src": node_id(width, height), "dst": node_id(width, height, "tf", "ty", "tx")})


def spatial_edges(voxels: DataFrame, width: int, height: int, cols: list[str]) -> DataFrame:
    """Every N8 edge once: right, below, below left, below right. Columns ``d_*`` are the
    neighbour's features."""
    moved = voxels.withColumn("o", _offsets(SPATIAL)).withColumns({"tf": F.col("frame"), "ty": F.col("y") + F.col("o.dy"), "tx": F.col("x") + F.col("o.dx"), "seq": F.col("o.seq")}).drop("o")
    return _pairs(voxels, moved, width, height, cols).withColumn("list_idx", 2 * F.col("frame"))


def temporal_edges(voxels: DataFrame, width: int, height: int, cols: list[str], flow: bool = False) -> DataFrame:
    """Edges to the 3 x 3 window in the frame before; the window is moved by the flow,
    truncated and clamped to the frame, if asked for."""
    y, x = F.col("y"), F.col("x")
    if flow:
        y = F.greatest(F.lit(0), F.least(F.lit(height - 1), (F.col("y") + F.col("fy")).cast("int")))
        x = F.greatest(F.lit(0), F.least(F.lit(width - 1), (F.col("x") + F.col("fx")).cast("int")))
    moved = voxels.withColumns({"py": y, "px": x}).withColumn("o", _offsets(TEMPORAL)).withColumns({
        "tf": F.col("frame") - 1, "ty": F.col("py") + F.col("o.dy"), "tx": F.col("px") + F.col("o.dx"), "seq": F.col("o.seq")}).drop("o")
    return _pairs(voxels, moved, width, height, cols).withColumn("list_idx", 2 * F.col("frame") - 1)


def bucket(weight: Column, buckets: int = BUCKETS, top: float = 1.000001) -> Column:
    """Quantised weight; the last bucket holds the virtual edges."""
    return F.least(F.lit(float(buckets)), weight * float(buckets) / F.lit(top)).cast("int")


def mergeable(a: Column, b: Column) -> Column:
    """Constraints agree: one side is free (-1), or both are equal."""
    return (a < 0) | (b < 0) | (a == b)


def label_neighbours(labels: DataFrame) -> DataFrame:
    """Symmetric (id, neighbor_id) over N8 in a frame and the window in the frame before."""
    cells = labels.select("frame", "y", "x", F.col("region_id").alias("id"))
    steps = [(0, a, b) for a, b in SPATIAL] + [(-1, a, b) for a, b in TEMPORAL]
    offs = F.explode(F.array(*[F.struct(F.lit(f).alias("df"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for f, a, b in steps]))
    moved = cells.withColumn("o", offs).select("id", (F.col("frame") + F.col("o.df")).alias("frame"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    pairs = moved.join(cells.withColumnRenamed("id", "neighbor_id"), ["frame", "y", "x"]).filter("id <> neighbor_id").select("id", "neighbor_id").distinct()
    return pairs.unionByName(pairs.select(F.col("neighbor_id").alias("id"), F.col("id").alias("neighbor_id"))).distinct()


def surviving_neighbours(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges mapped to representatives, without inner ones, as symmetric neighbour sets."""
    rep = lambda k: assignment.select(F.col("node").alias(k), F.col("rep").alias(f"r_{k}"))
    mapped = edges.join(rep("src"), "src").join(rep("dst"), "dst").filter("r_src <> r_dst").select("r_src", "r_dst")
    both = mapped.unionByName(mapped.select(F.col("r_dst").alias("r_src"), F.col("r_src").alias("r_dst"))).distinct()
    return both.groupBy(F.col("r_src").alias("rep")).agg(F.array_sort(F.collect_list("r_dst")).alias("neighbours"))


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``. Only a local
    session, whose executors share the driver's disk, may leave it unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def positions(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``position``, their number from 0 in the order of a unique key.

    Rows are dealt by ranges of the key and numbered inside each; only the row count of each
    range is gathered, never the rows."""
    at = durable(rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__n", F.monotonically_increasing_id()))
    part, own = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    # One row a range.
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return at.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("position", own + F.col("__before")).drop("__n", "__part", "__before")


def min_label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, rep): smallest node of each component. Labels spread along edges and jump to
    the label of the label, so long chains take few rounds; it ends when no label changes."""
    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    at = durable(nodes.select("node", F.col("node").alias("rep")))
    while True:
        near = both.join(at.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("rep").alias("m"))
        step = at.join(near, "node", "left").select("node", F.least("rep", F.coalesce("m", "rep")).alias("rep"), F.col("rep").alias("was"))
        jump = step.select(F.col("node").alias("rep"), F.col("rep").alias("far"))
        now = durable(step.join(jump, "rep", "left").select("node", F.least("rep", F.coalesce("far", "rep")).alias("rep"), "was"))
        changed = now.filter("rep <> was").limit(1).count()
        at = now.select("node", "rep")
        if not changed:
            return at


def interval_edges(intervals: DataFrame, n8: bool) -> DataFrame:
    """Links (src, dst) between touching intervals of one region in one frame."""
    from tessera.operators.raster import touching

    a, b = intervals.alias("a"), intervals.alias("b")
    same = (F.col("a.frame") == F.col("b.frame")) & (F.col("a.region_id") == F.col("b.region_id"))
    below = a.join(b, same & (F.col("b.y") == F.col("a.y") + 1) & touching("a", "b", n8)).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    if not n8:
        return below
    beside = a.join(b, same & (F.col("b.y") == F.col("a.y")) & (F.col("b.left_x") == F.col("a.right_x") + 1)).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    return below.unionByName(beside)
