"""Approximate nearest neighbours by additive quantisation.

``fit`` learns ``books`` full-dimensional codebooks, each on what the ones before leave,
from a bounded sample (at most about ``sample`` rows, chosen by hash). ``index`` encodes
*every* row by beam search over the residual codebooks and stores the codes with the
squared norm of the reconstruction. ``search`` scores codes against a query by one table
of inner products (distance = stored norm - 2 x sum of table entries, up to the query's own
norm), and reranks the best ``shortlist`` of each part of PART index rows exactly on the
original vectors. Queries go in blocks of bounded size; a part returns k rows per query.

Rows that cannot take part (see ``vectors.usable``) are neither queries nor candidates.
Equal distances go to the smaller id; fewer than k candidates give fewer rows; rows that
repeat an id are candidates each, but none is a candidate of its own id; an empty table gives
an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable
from tessera.llm.vectors import best, fixed_parts, matrix, query_blocks, usable

PART = 8192


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x entries x dimension, float32

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books, uint8) and squared norms of the reconstructions."""
        x = x.astype(np.float32)
        n, books = len(x), len(self.words)
        rest = x[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for words in self.words:
            norm = (words * words).sum(axis=1)
            cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * rest @ words.T + norm
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            pick = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, entry = np.divmod(pick, len(words))
            at = np.arange(n)[:, None]
            codes = np.concatenate([codes[at, parent], entry[:, :, None].astype(np.uint8)], axis=2)
            rest = rest[at, parent] - words[entry]
        last = (rest * rest).sum(axis=2).argmin(axis=1)
        codes = codes[np.arange(n), last]
        made = sum(self.words[m][codes[:, m]] for m in range(books))
        return codes, (made.astype(np.float64) ** 2).sum(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((words * words).sum(axis=1) - 2 * x @ words.T).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(starts, len(x)), axis=0)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return words


def fit(rows: DataFrame, dim: int, books: int = 16, entries: int = 256, sample: int = 12000, rounds: int = 8) -> Codebooks:
    """Learn codebooks on a bounded sample of usable rows."""
    n = rows.count()
    if not n:
        return Codebooks(np.zeros((books, entries, dim), np.float32))
    share = min(1.0, sample / n)
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit("ann"), "vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toArrow()
    column = drawn.column(0).combine_chunks()
    rng = np.random.default_rng(7)
    rest = matrix(column, dim).astype(np.float32) if len(column) else np.zeros((1, dim), np.float32)
    words = []
    for _ in range(books):
        words.append(_kmeans(rest, entries, rounds, rng))
        near = ((words[-1] ** 2).sum(axis=1) - 2 * rest @ words[-1].T).argmin(axis=1)
        rest = rest - words[-1][near]
    return Codebooks(np.stack(words))


def index(rows: DataFrame, dim: int, books: Codebooks) -> DataFrame:
    """Index rows: ``vec_id``, ``v``, ``codes`` (one byte per book), ``norm``; written durably."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # books x entries x dimension floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                codes, norm = shared.value.encode(matrix(part.column(1), dim))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], names=["vec_id", "v", "codes", "norm"])

    return durable(rows.mapInArrow(run, "vec_id long, v array<double>, codes binary, norm double"))


def search(indexed: DataFrame, queries: DataFrame, dim: int, books: Codebooks, k: int = 10, shortlist: int = 512, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): nearest candidates by exact Euclidean distance."""
    spark = indexed.sparkSession
    parts = []
    for ids, q in query_blocks(queries, dim, block):
        tables = np.einsum("qd,med->qme", q.astype(np.float32), books.words)
        shared = spark.sparkContext.broadcast((ids, q, tables))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, tables = shared.value
            n_books = tables.shape[1]
            kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(ids)
            for batch in fixed_parts(batches, PART):
                vec_ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, n_books)
                norm = batch.column(3).to_numpy().astype(np.float32)
                short = min(shortlist + 1, len(x))
                for j in range(len(ids)):
                    est = norm.copy()
                    table = tables[j]
                    for m in range(n_books):
                        est -= 2 * table[m].take(codes[:, m])
                    pick = np.argpartition(est, short - 1)[:short] if short < len(x) else np.arange(len(x))
                    pick = pick[vec_ids[pick] != ids[j]]
                    dist = np.sqrt(((x[pick] - q[j]) ** 2).sum(axis=1))
                    got = vec_ids[pick]
                    if kept[j] is not None:
                        got, dist = np.concatenate([kept[j][0], got]), np.concatenate([kept[j][1], dist])
                    order = np.lexsort((got, dist))[:k]
                    kept[j] = got[order], dist[order]
            full = [(np.full(len(x[0]), ids[j]), *x) for j, x in enumerate(kept) if x is not None and len(x[0])]
            if full:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*full)], names=["query_id", "vec_id", "score"])

        parts.append(indexed.mapInArrow(run, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return best(found, k, ascending=True)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", k: int = 10) -> DataFrame:
    """Fit, index every usable row, and search for the rows where ``is_query`` holds."""
    rows, dim = usable(vectors, id_col, vec, zero_ok=False)
    if not dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit(rows, dim)
    indexed = index(rows, dim, books)
    return search(indexed, indexed.filter(is_query).select("vec_id", "v"), dim, books, k)
