"""Hierarchies stored as rows: (level, id, size, parent_id, start_frame, end_frame,
neighbor_id[], child_id[]); parent -1 marks a top row; arrays are sorted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_up(level: DataFrame) -> DataFrame:
    """Sizes and bounds of the parents of a level."""
    return level.groupBy(F.col("parent_id").alias("id")).agg(F.sum("size").cast("long").alias("size"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


def build_levels(base: DataFrame, pairs: DataFrame, fan: list[int]) -> DataFrame:
    """Hierarchy whose parent id is id div fan at each level. ``pairs``: (id, neighbor_id)."""
    out, level, edges = [], base, pairs
    sort = lambda c: F.coalesce(F.array_sort(c), F.array().cast("array<int>"))
    kids = None
    for k in range(len(fan) + 1):
        top = k == len(fan)
        level = level.withColumn("parent_id", F.lit(-1) if top else F.expr(f"cast(id div {fan[k]} as int)"))
        near = edges.groupBy("id").agg(F.collect_set("neighbor_id").alias("neighbor_id"))
        row = level.join(near, "id", "left")
        row = row.join(kids, "id", "left") if kids is not None else row.withColumn("child_id", F.lit(None).cast("array<int>"))
        out.append(row.select(F.lit(k).alias("level"), "id", "size", "parent_id", "start_frame", "end_frame", sort(F.col("neighbor_id")).alias("neighbor_id"), sort(F.col("child_id")).alias("child_id")))
        if not top:
            kids = level.groupBy(F.col("parent_id").alias("id")).agg(F.collect_list("id").alias("child_id")).select("id", "child_id")
            level = roll_up(level)
            edges = edges.select(F.expr(f"cast(id div {fan[k]} as int)").alias("id"), F.expr(f"cast(neighbor_id div {fan[k]} as int)").alias("neighbor_id")).filter("id <> neighbor_id").distinct()
    return reduce(DataFrame.unionByName, out)


def ancestors(tree: DataFrame, level: int, query_level: int) -> DataFrame:
    """(id, ancestor) from a level up to another; one equi-join per step."""
    at = tree.filter(F.col("level") == level).select("id", F.col("id").alias("ancestor"))
    for k in range(level, query_level):
        up = tree.filter(F.col("level") == k).select(F.col("id").alias("ancestor"), "parent_id")
        at = at.join(up, "ancestor").select("id", F.col("parent_id").alias("ancestor"))
    return at


def parent_map(tree: DataFrame, ids: DataFrame, level: int, query_level: int) -> DataFrame:
    """(parent, members): ids grouped by their ancestor."""
    return ancestors(tree, level, query_level).join(ids, "id", "left_semi").groupBy(F.col("ancestor").alias("parent")).agg(F.array_sort(F.collect_list("id")).alias("members"))


def descendants(tree: DataFrame, ids: DataFrame, level: int, query_level: int) -> DataFrame:
    """(id, descendant) from a level down to another, by exploding child lists."""
    at = ids.select("id", F.col("id").alias("descendant"))
    for k in range(level, query_level, -1):
        down = tree.filter(F.col("level") == k).select(F.col("id").alias("descendant"), "child_id")
        at = at.join(down, "descendant").select("id", F.explode("child_id").alias("descendant"))
    return at


def constrain_to_frames(tree: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows that overlap [lo, hi], with ids of dropped rows taken out of neighbour lists;
    parents and children stay as they are."""
    kept = tree.filter((F.col("start_frame") <= hi) & (F.col("end_frame") >= lo))
    near = kept.select("level", "id", F.explode("neighbor_id").alias("n")).join(kept.select("level", F.col("id").alias("n")), ["level", "n"], "left_semi")
    lists = near.groupBy("level", "id").agg(F.array_sort(F.collect_list("n")).alias("kept_near"))
    return kept.join(lists, ["level", "id"], "left").withColumn("neighbor_id", F.coalesce("kept_near", F.array().cast("array<int>"))).drop("kept_near")


def outside_flags(tree: DataFrame, spans: DataFrame, lo: int, hi: int, top: int) -> DataFrame:
    """(level, id, flagged): a leaf is flagged if it has no slice in [lo, hi); a parent if
    all its children are."""
    leaf = tree.filter("level = 0").join(spans, "id", "left").select(
        "id", "parent_id", F.coalesce((F.col("first") >= hi) | (F.col("last") < lo), F.lit(True)).alias("flagged"))
    out, at = [leaf.select(F.lit(0).alias("level"), "id", "flagged")], leaf
    for k in range(1, top + 1):
        up = at.groupBy(F.col("parent_id").alias("id")).agg(F.min("flagged").alias("flagged"))
        at = tree.filter(F.col("level") == k).select("id", "parent_id").join(up, "id")
        out.append(at.select(F.lit(k).alias("level"), "id", "flagged"))
    return reduce(DataFrame.unionByName, out)


def merge_regions(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys as one: sizes add, lists unite, bounds widen."""
    unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return tree.groupBy(*keys).agg(F.sum("size").cast("long").alias("size"), unite("neighbor_id"), F.min("parent_id").alias("parent_id"), unite("child_id"),
                                   F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))


def build_global(chunks: DataFrame) -> DataFrame:
    """Fold chunk hierarchies (column ``chunk``, ``offset``) into one: cut to the lowest
    level count, drop the parents of the new top, shift frames (not those of the first
    chunk), merge by id."""
    found = chunks.groupBy("chunk").agg((F.max("level") + 1).alias("n")).agg(F.min("n").alias("n_levels"), F.min("chunk").alias("c0")).first()
    n_levels, first = found["n_levels"] or 0, found["c0"]
    cut = chunks.filter(F.col("level") < n_levels)
    shift = F.when(F.col("chunk") == F.lit(first), 0).otherwise(F.col("offset"))
    moved = cut.withColumns({
        "parent_id": F.when(F.col("level") == n_levels - 1, -1).otherwise(F.col("parent_id")),
        "start_frame": F.col("start_frame") + shift, "end_frame": F.col("end_frame") + shift,
    })
    return merge_regions(moved, ["level", "id"])


def violations(tree: DataFrame) -> DataFrame:
    """(check, level, id, other_id) of every broken rule; empty for a valid hierarchy."""
    near = tree.select("level", "id", F.explode("neighbor_id").alias("other_id"))
    back = near.select("level", F.col("other_id").alias("id"), F.col("id").alias("other_id"))
    kids = tree.filter("level > 0").select("level", "id", F.explode("child_id").alias("other_id"))
    up = tree.filter("parent_id >= 0").select((F.col("level") + 1).alias("level"), F.col("parent_id").alias("id"), F.col("id").alias("other_id"))
    keys = ["level", "id", "other_id"]
    rolled = roll_up(tree.filter("parent_id >= 0").withColumn("parent_id", F.struct((F.col("level") + 1).alias("level"), F.col("parent_id").alias("id")))).select("id.level", "id.id", F.col("size").alias("s"), F.col("start_frame").alias("a"), F.col("end_frame").alias("b"))
    at = tree.join(rolled, ["level", "id"])
    none = F.lit(-1).alias("other_id")
    parts = [
        near.join(back, keys, "left_anti").select(F.lit("mutual_neighbour").alias("check"), *keys),
        kids.join(up, keys, "left_anti").select(F.lit("child_without_parent").alias("check"), *keys),
        up.join(kids, keys, "left_anti").select(F.lit("parent_without_child").alias("check"), *keys),
        at.filter("size <> s").select(F.lit("child_sizes").alias("check"), "level", "id", none),
        at.filter("start_frame <> a or end_frame <> b").select(F.lit("bounds").alias("check"), "level", "id", none),
    ]
    return reduce(DataFrame.unionByName, parts)
