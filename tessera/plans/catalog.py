"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hierarchy, raster
from tessera.plans import descriptors, fixtures, graphs, rasters, scalar

MODULES = (scalar, rasters, graphs, descriptors)


def region_pixels(spark: SparkSession, sf_dir: str, level: int = 1) -> DataFrame:
    """Pixels per region at a hierarchy level for each frame: scan, measure, climb, add."""
    areas = raster.area(fixtures.scan_intervals(spark, sf_dir), ["frame", "region_id"])
    up = hierarchy.ancestors(fixtures.hierarchy_levels(spark, sf_dir), 0, level).withColumnRenamed("id", "region_id")
    return areas.join(up, "region_id").groupBy("frame", F.col("ancestor").alias("parent")).agg(F.sum("area").alias("pixels"))


REGION_PIXELS = fixtures.with_views("labels", "SELECT frame, CAST(region_id // 2 AS INTEGER) AS parent, count(*) AS pixels FROM labels GROUP BY 1, 2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"region_pixels_at_level": region_pixels} | {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"region_pixels_at_level": REGION_PIXELS} | {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_pixels(spark, sf_dir)
