"""SimHash near-duplicates: fingerprints, pivot distance tables, linked components.

Fingerprint: words are maximal runs without ASCII white space after A-Z is
lower-cased; every shingle of ``width`` words is hashed with XXH64 (seed 42) and a
bit is set if more than half of the hashes have it. No words: fingerprint 0.

Links: two fingerprints link when at most ``radius`` of 64 bits differ. Equal
fingerprints are one class, searched once. Classes meet in cells: the 64 bits are cut
in radius+1 runs, of which one must agree. A cell of more than ``cell_rows`` classes is
cut again by the bits outside its run (the same argument holds for what is left), and
what is still larger is compared in tiles. Inside a cell the table of distances to
``pivots`` reference fingerprints discards pairs with a coordinate difference above the
radius (triangle inequality); exact popcounts verify the survivors.

Null text counts as empty text. Rows stand each for their own text, also where they repeat
an id; rows without an id link others like any row, but no component is named after them (a
component of such rows alone has a null id). Very long texts are hashed whole; empty input
gives an empty result; only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import components, durable

BITS = 64
CHUNK = 65536


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint column."""

    @pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.array([fingerprint(x, width) for x in part], np.uint64).view(np.int64))

    return docs.withColumn(out, simhash(F.col(text).cast("binary")))


def reference_fingerprints(n: int) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, n, dtype=np.uint64)


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts) if len(x)]


def _masked(bits: list[int]):
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << BITS) if mask >> 63 else mask))


def close_pairs(fp: np.ndarray, table: np.ndarray, radius: int, left: slice | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within radius, found through the pivot table of the same rows.

    ``left``: only rows of that slice are held against the rows after it.
    """
    n, rows = len(fp), max(1, (1 << 21) // max(1, len(fp)))
    lo, hi = (0, n) if left is None else (left.start, left.stop)
    for k in range(lo, hi, rows):
        i, first = np.arange(k, min(hi, k + rows)), (k + 1 if left is None else hi)
        if first >= n:
            continue
        keep = np.abs(table[i, None, 0].astype(np.int8) - table[None, first:, 0].astype(np.int8)) <= radius
        a, b = np.nonzero(keep)
        a, b = a + k, b + first
        if left is None:
            a, b = a[b > a], b[b > a]
        for c in range(1, table.shape[1]):
            ok = np.abs(table[a, c].astype(np.int8) - table[b, c].astype(np.int8)) <= radius
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        if ok.any():
            yield a[ok], b[ok]


def _links(radius: int, pivots: int):
    """mapInArrow over rows sorted by (cell, side): star links inside each cell."""
    refs = reference_fingerprints(pivots)

    def solve(fp: np.ndarray, node: np.ndarray, side: np.ndarray):
        mixed = side.min() != side.max()
        order = np.argsort(side, kind="stable")
        fp, node, side = fp[order], node[order], side[order]
        table = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
        root = np.arange(len(fp))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in close_pairs(fp, table, radius, slice(0, int((side == side[0]).sum())) if mixed else None):
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    if node[x] > node[y]:
                        x, y = y, x
                    root[y] = x
        tops = np.array([find(x) for x in range(len(root))])
        moved = tops != np.arange(len(root))
        return node[moved], node[tops[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        ends = object()

        def groups():
            nonlocal rest
            for batch in batches:
                part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
                if rest is not None:
                    part = [np.concatenate(x) for x in zip(rest, part)]
                cell = part[0]
                if not len(cell):
                    continue
                cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
                last = int(cuts[-1]) if len(cuts) else 0
                bounds = [0, *cuts.tolist()]
                for x, y in zip(bounds, bounds[1:]):
                    yield [p[x:y] for p in part]
                rest = [p[last:] for p in part]
            yield rest if rest is not None else ends

        us: list[np.ndarray] = []
        vs: list[np.ndarray] = []
        held = 0
        for g in groups():
            if g is ends or len(g[0]) < 2:
                continue
            u, v = solve(g[1].view(np.uint64), g[2], g[3])
            if len(u):
                us.append(u), vs.append(v)
                held += len(u)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["a", "b"])
                us, vs, held = [], [], 0
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["a", "b"])

    return run


def near_links(classes: DataFrame, radius: int = 4, pivots: int = 24, cell_rows: int = 1024, depth: int = 2) -> DataFrame:
    """Links (a, b) that connect the same classes as all pairs within radius do.

    ``classes``: one row per distinct fingerprint, columns ``fp`` and ``node`` (long).
    Each cell returns at most one link per member, never its pairs.
    """
    found: list[DataFrame] = []
    every = list(range(BITS))
    at = classes.select("fp", "node", F.lit(0).cast("long").alias("cell"))
    levels = [(every, None)]
    for step in range(depth):
        keyed = None
        # Each open bit set is cut in radius + 1 runs; `path` names the runs taken so far.
        options = []
        for open_bits, path in levels:
            for r, run in enumerate(_cuts(open_bits, radius + 1)):
                options.append((path, f"{path or ''}/{r}", run, [b for b in open_bits if b not in run]))
        keys = F.array(*[
            F.struct(F.lit(name).alias("path"), F.xxhash64(F.lit(name), F.col("cell"), _masked(run)).alias("cell"))
            for parent, name, run, _ in options
        ]) if step == 0 else None
        if step == 0:
            keyed = at.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.path", "k.cell")
        else:
            parts = [
                at.filter(F.col("path") == parent).select("fp", "node", F.lit(name).alias("path"), F.xxhash64(F.lit(name), F.col("cell"), _masked(run)).alias("cell"))
                for parent, name, run, _ in options
            ]
            keyed = parts[0]
            for p in parts[1:]:
                keyed = keyed.unionByName(p)
        sizes = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = durable(sizes.filter(F.col("n") > cell_rows))
        n_large = large.count()
        if not n_large:
            found.append(keyed.withColumn("side", F.lit(0)))
            large = None
            break
        found.append(keyed.join(large, "cell", "left_anti").withColumn("side", F.lit(0)))
        at = durable(keyed.join(large, "cell"))
        levels = [(left, name) for _, name, _, left in options]
    else:
        # Tiles: row i of a cell meets every tile of its cell once.
        tiles = F.ceil(F.col("n") / cell_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
        tiled = at.withColumn("tiles", tiles).withColumn("own", own).select(
            "fp", "node", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        found.append(tiled.select(
            "fp", "node", F.lit("").alias("path"),
            F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")))
    rows = None
    for f in found:
        part = f.select("cell", "fp", "node", F.col("side").cast("int").alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    placed = rows.repartition("cell").sortWithinPartitions("cell")
    return placed.mapInArrow(_links(radius, pivots), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``."""
    prints = durable(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), width).select("id", "fp"))
    classes = durable(prints.groupBy("fp").agg(F.min("id").alias("first")))
    # Classes are linked by their fingerprints, so that one without any id links others too.
    links = durable(near_links(classes.select("fp", F.col("fp").alias("node")), radius))
    named = classes.join(components(links, "a", "b").withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", width: int = 5, radius: int = 4) -> DataFrame:
    """Documents with one member of each component kept: the one with the smallest id.

    Five-word shingles unless told otherwise. Of rows that repeat the kept id one
    stays. Rows with a null id are kept as they are.
    """
    comp = durable(near_duplicates(docs, id_col, width=width, radius=radius))
    keep = comp.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col)).distinct()
    kept = docs.join(keep, id_col, "left_semi")
    if comp.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull())).select(*docs.columns)
