"""Shared helpers: durable cuts of lineage, input tables, components of a link graph."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only a local session (tests, a
    laptop), whose executors share the driver's disk, may leave it unset.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=eager)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = (
        both.filter("v > u").join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    )
    low2 = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return joined.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()


def _open(edges: DataFrame) -> bool:
    """Whether edges (u > v) are more than stars: a node has two edges down, or is both ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return sums.filter("ups > 1 or (ups = 1 and low = 0)").limit(1).count() > 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node on an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps, every one a group-by and an
    equi-join, so no star is ever gathered in one task; the number of rounds grows
    with the logarithm of the longest path and ends when only stars are left. Self loops
    and nulls are ignored.
    """
    at = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v").distinct()
    )
    while _open(at):
        at = durable(_stars(at))
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
