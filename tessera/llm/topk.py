"""Exact top-k inner products over an impact-ordered index, score at a time.

A vector's components are integers floor(scale x x), each a posting (dimension, value).
``index`` quantises the postings by magnitude into levels, shares of the largest magnitude of
the table, and writes once, for every vector, its values, the level of each, and the length of
what the levels below still hold. A part of the index is scanned as one segment of postings a
level, largest magnitudes first. A query block takes the segments in descending impact and
adds them to its accumulators. After each one, no vector can gain more than |query| x (what it
still holds), by Cauchy-Schwarz; a vector whose accumulator plus that gain is below the
query's k-th best proven score is out. Only when few vectors may still be members, or no
segment is left, does a query stop, and then it rescores exactly those. Nothing is cut without
that proof, which allows for the rounding of its own sums.

Ties go to the smaller id. Rows as in ``vectors.usable``, zero vectors included; rows that
repeat an id are candidates each, but none of its own id; an empty table gives an empty
result; other columns are not read, whatever their names. Scores are exact integers; those
beyond 64 bits are set to the end of that range and tie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable
from tessera.llm.vectors import best, fixed_parts, matrix, query_blocks, usable

# Lower bounds of a level's magnitudes, as shares of the largest one in the table.
LEVELS = (0.25, 0.12, 0.06, 0.0)
BLOCK_ROWS, BLOCK_QUERIES, FEW = 4096, 256, 48
#: Below this every partial sum of products is an exact double.
EXACT = 2.0**53


def quantise(x: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Level of each component, and the length of what lies below each level, by vector."""
    size = np.abs(x)
    level = sum((size < share * top).astype(np.uint8) for share in LEVELS)
    return level, np.stack([np.linalg.norm(np.where(level > k, x, 0.0), axis=1) for k in range(len(LEVELS))], axis=1)


class ImpactIndex:
    """Segments of one part of the index by descending quantised impact."""

    def __init__(self, x: np.ndarray, level: np.ndarray, rest: np.ndarray):
        self.x, self.rest = x, rest.T
        self.segments = [np.where(level == k, x, 0.0) for k in range(len(LEVELS))]
        self.length = np.linalg.norm(x, axis=1)

    def members(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query row, rows that may be among its k best), given proven k-th scores.

        ``own`` marks rows that are the query itself; they prove nothing.
        """
        open_rows = np.arange(len(q))
        if not np.abs(q).max(initial=0.0) * np.abs(self.x).max(initial=0.0) < 1e150:
            yield from ((j, np.arange(len(self.x))) for j in open_rows.tolist())  # lengths would overflow
            return
        norm = np.linalg.norm(q, axis=1)
        acc = np.zeros((len(q), len(self.x)))
        floor = floor.copy()
        for level, segment in enumerate(self.segments):
            acc[open_rows] += q[open_rows] @ segment.T
            gain = norm[open_rows, None] * (self.rest[level] * (1 + 1e-9) + self.length * 1e-12) + 1e-6
            now = acc[open_rows]
            if now.shape[1] > k:
                floor[open_rows] = np.maximum(floor[open_rows], np.partition(np.where(own[open_rows], -np.inf, now - gain), -k, axis=1)[:, -k])
            may = now + gain >= floor[open_rows, None]
            few = may.sum(axis=1) <= FEW
            done = few | (level == len(self.segments) - 1)
            for j in np.flatnonzero(done):
                yield int(open_rows[j]), np.flatnonzero(may[j])
            open_rows = open_rows[~done]
            if not len(open_rows):
                return


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; exact also where 64-bit sums of doubles would not be."""
    if (np.abs(x) @ np.abs(q)).max(initial=0.0) < EXACT:
        return (x @ q).astype(np.int64)
    most = (1 << 63) - 1
    return np.array([max(-most - 1, min(most, sum(int(a) * int(b) for a, b in zip(row, q)))) for row in x], dtype=np.int64)


def index(rows: DataFrame, dim: int, scale: float = 256.0) -> DataFrame:
    """Index rows: ``vec_id``, ``x`` (integers), ``level`` (a byte each), ``rest``; written durably."""
    top = float(np.floor(rows.agg(F.max(F.array_max(F.transform("v", lambda e: F.abs(e * scale) + 1.0))).alias("m")).first()["m"] or 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in fixed_parts(batches, BLOCK_ROWS):
            x = np.floor(scale * matrix(batch.column(1), dim))
            level, rest = quantise(x, top)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.float64())) for a in (x, rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists[0], pa.array([r.tobytes() for r in level], pa.binary()), lists[1]], names=["vec_id", "x", "level", "rest"])

    return durable(rows.mapInArrow(run, "vec_id long, x array<double>, level binary, rest array<double>"))


def search(indexed: DataFrame, queries: DataFrame, dim: int, k: int = 5, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): ``queries`` are (vec_id, v) rows of integers."""
    spark = indexed.sparkSession
    parts = []
    for ids, q in query_blocks(queries, dim, block):
        shared = spark.sparkContext.broadcast((ids, q))  # block x dimension doubles

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            floor = np.full(len(ids), -np.inf)
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
            for part in fixed_parts(batches, BLOCK_ROWS):
                vec_ids, x = part.column(0).to_numpy(), matrix(part.column(1), dim)
                level = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(x), dim)
                built = ImpactIndex(x, level, matrix(part.column(3), len(LEVELS)))
                for b in range(0, len(ids), BLOCK_QUERIES):
                    own = ids[b : b + BLOCK_QUERIES, None] == vec_ids
                    for j, rows_of in built.members(q[b : b + BLOCK_QUERIES], own, floor[b : b + BLOCK_QUERIES], k):
                        j += b
                        rows_of = rows_of[vec_ids[rows_of] != ids[j]]
                        if not len(rows_of):
                            continue
                        got = np.concatenate([kept[j][0], vec_ids[rows_of]])
                        score = np.concatenate([kept[j][1], _scores(x[rows_of], q[j])])
                        order = np.lexsort((got, ~score))[:k]
                        kept[j] = got[order], score[order]
                        if len(order) == k:
                            floor[j] = max(floor[j], float(score[order[-1]]))
            full = [(np.full(len(x[0]), ids[j]), *x) for j, x in enumerate(kept) if len(x[0])]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*full)], names=["query_id", "vec_id", "score"])

        parts.append(indexed.mapInArrow(run, "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return best(found, k, ascending=False)


def top_products(vectors: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """Exact top k for every usable row where ``is_query`` holds."""
    rows, dim = usable(vectors, id_col, vec, zero_ok=True)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    indexed = index(rows, dim, scale)
    return search(indexed, indexed.filter(is_query).select("vec_id", F.col("x").alias("v")), dim, k)
