"""Vector rows shared by the nearest-neighbour and top-k operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec: str, zero_ok: bool) -> tuple[DataFrame, int]:
    """(``vec_id``, ``v``) rows that take part, and their dimension.

    Out: null ids; vectors null, empty, or holding null, NaN or infinite components; zero
    vectors unless ``zero_ok``; and vectors of another length than the most common one.
    """
    v = F.col(vec).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    if not zero_ok:
        rows = rows.filter(F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 0
    return rows.filter(F.size("v") == dim), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def fixed_parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in parts of ``size`` (the last may be shorter), so that what is
    done by part does not depend on the session's batch size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            rows = pa.Table.from_batches(held).combine_chunks()
            whole = n // size * size
            for k in range(0, whole, size):
                yield rows.slice(k, size).to_batches()[0]
            held, n = rows.slice(whole).to_batches(), n - whole
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def query_blocks(queries: DataFrame, dim: int, block: int):
    """Query (ids, matrix) in blocks of bounded size, each fetched by its own job."""
    n = queries.count()
    parts = max(1, -(-n // block))
    for k in range(parts if n else 0):
        # A hash deals the queries; a block holds its share give or take a few deviations.
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).select("vec_id", "v").toArrow().combine_chunks()
        if got.num_rows:
            ids, column = got.column(0), got.column(1)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            yield ids.to_numpy(), matrix(column, dim)


def best(found: DataFrame, k: int, ascending: bool) -> DataFrame:
    """The k best candidates of each query with their rank; ties to the smaller vec_id."""
    order = F.col("score").asc() if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
