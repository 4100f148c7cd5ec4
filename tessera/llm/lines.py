"""Line dedup by pairwise alignment.

Equal texts are one class; its document with the smallest id is the original. Classes
are paired through hashes of *windows*: for each line the shortest run of whole lines that
starts, and the shortest that ends, with it and has ``min_block`` characters, short lines
included. Every line of a block that two classes share lies in such a window inside that
block, whether its lines are rare or not. Each holder of a window pairs with its first
holder; whatever an earlier class shares, the first holder of each of its windows shares
too, so no other pairs are needed and none is ignored, however frequent its lines are.

Each pair is aligned by patience diff (lines unique on both sides anchor the longest
increasing run; the gaps are aligned again; equal ends are matched). Blocks that stand in
another order, and blocks whose lines repeat too often to anchor, are left over by that;
they are aligned at the windows that the earlier text also holds, and grown both ways.
Every run of aligned lines of at least ``min_block`` characters is deleted from the later
document. So a line goes if and only if it lies in a run of whole lines of ``min_block``
characters that an earlier document has. A later copy of a whole text is one such run.
Order is (id, text digest); lines are compared by 64-bit hashes.

Null text counts as empty and stays null; null ids sort after all others; rows that
repeat both id and text are treated alike; very long texts are aligned whole; an empty
table gives an empty result; other columns pass through, but ``n_lines`` and ``n_removed``
are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable

LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Longest increasing run of lines that occur once in a and once in b."""
    ca, cb = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if cb[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a) if ca[x] == 1 and x in where]
    tails: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back[k] = tops[at - 1] if at else -1
        tails[at : at + 1], tops[at : at + 1] = [j], [k]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two line sequences, increasing on both sides."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo < ahi and blo < bhi:
            marks = _anchors(a[alo:ahi], b[blo:bhi])
            if marks:
                i, j = alo, blo
                for x, y in [*((alo + x, blo + y) for x, y in marks), (ahi, bhi)]:
                    work.append((i, x, j, y))
                    if x < ahi:
                        out.append((x, y))
                    i, j = x + 1, y + 1
    return sorted(out)


def _runs(pairs: list[tuple[int, int]], sizes: list[int], min_block: int) -> set[int]:
    """Line numbers of a in runs of consecutive pairs of at least min_block characters."""
    gone: set[int] = set()
    run: list[int] = []
    was = (-2, -2)
    for pair in [*pairs, (-9, -9)]:
        if pair != (was[0] + 1, was[1] + 1):
            if sum(sizes[i] for i in run) >= min_block:
                gone.update(run)
            run = []
        run.append(pair[0])
        was = pair
    return gone


def common_blocks(a: list[int], sizes: list[int], b: list[int], min_block: int) -> list[int]:
    """Line numbers of a in blocks of at least min_block characters that b has: those that
    patience diff aligns, then those that it leaves over."""
    gone = _runs(patience(a, b), sizes, min_block)
    size_of = dict(zip(a, sizes))
    held = size_of.keys() & set(b)
    if sum(n for i, (x, n) in enumerate(zip(a, sizes)) if x in held and i not in gone) == 0 or sum(n for x, n in zip(a, sizes) if x in held) < min_block:
        return sorted(gone)
    # A line that only b has counts as a whole block, so no window of a can look like its own.
    there = windows(np.array(b, np.int64), np.array([size_of.get(x, min_block) for x in b], np.int64), min_block)
    at = dict(zip(there[2][::-1].tolist(), there[0][::-1].tolist()))
    for first, last, run in zip(*(x.tolist() for x in windows(np.array(a, np.int64), np.array(sizes, np.int64), min_block))):
        j = at.get(run)
        if j is None or gone.issuperset(range(first, last)) or a[first:last] != b[j : j + last - first]:
            continue
        i, end = first, last
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end < len(a) and j + end - i < len(b) and a[end] == b[j + end - i]:
            end += 1
        gone.update(range(i, end))
    return sorted(gone)


def _align(min_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                keys, gone = [], []
                for key, a, sizes, b in zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns)):
                    found = common_blocks(a, sizes, b, min_block)
                    if found:
                        keys.append(key), gone.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    return run


def windows(lines: np.ndarray, sizes: np.ndarray, min_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last, and hash of the shortest windows of min_block
    characters from and up to each line."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    every = np.arange(len(ends))
    stop = np.searchsorted(ends, ends + min_block, "left")
    start = np.searchsorted(ends, ends - min_block, "right") - 1
    first = np.concatenate([every[stop < len(ends)], start[start >= 0]])
    last = np.concatenate([stop[stop < len(ends)], every[start >= 0]])
    power = np.full(len(lines) + 1, BASE, np.uint64)
    back = np.full(len(lines) + 1, UNBASE, np.uint64)
    power[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.astype(np.int64).view(np.uint64) * np.cumprod(power)[:-1], dtype=np.uint64)])
    found = (sums[last] - sums[first]) * np.cumprod(back)[first] + (last - first).astype(np.uint64)
    return first, last, found.view(np.int64)


def block_windows(lines: np.ndarray, sizes: np.ndarray, min_block: int) -> np.ndarray:
    """Distinct hashes of the windows of a text."""
    return np.unique(windows(lines, sizes, min_block)[2])


def _windows(min_block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                found = [block_windows(a.values.to_numpy(), b.values.to_numpy(), min_block) for a, b in zip(part.column(2), part.column(3))]
                counts = [len(x) for x in found]
                own = [pa.array(np.repeat(part.column(c).to_numpy(), counts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *own], names=["run", "first", "code"])

    return run


def mark_common_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_block: int = 100) -> DataFrame:
    """(``id``, ``key``, ``n_lines``, ``gone``): distinct (id, text digest) with the numbers
    of the lines to delete; ``gone`` is null where nothing goes."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = F.split(t, "\n")
    rows = durable(docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.md5(t.cast("binary")).alias("key"),
        F.transform(split, lambda x: F.xxhash64(x)).alias("lines"), F.transform(split, lambda x: F.length(x)).alias("sizes"),
    ))
    classes = durable(rows.groupBy("key").agg(F.min("id").alias("first"), F.min(F.struct("lines", "sizes")).alias("seq")).select("key", "first", "seq.lines", "seq.sizes"))
    coded = classes.withColumn("code", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
    held = (
        coded.filter(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x) >= min_block)
        .select("first", "code", "lines", "sizes").mapInArrow(_windows(min_block), "run long, first long, code long")
        .select("run", F.struct("first", "code").alias("at"))
    )
    # Cut here, so that the join below meets rows straight from shuffles and a window that
    # very many classes hold can be split over tasks.
    runs = durable(held.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("head")).filter("n > 1").select("run", "head"))
    shared = held.join(runs, "run").filter("at <> head")
    pairs = shared.select(F.col("at.code").alias("later"), F.col("head.code").alias("earlier")).distinct()
    later = coded.select(F.col("code").alias("later"), "key", "lines", "sizes")
    earlier = coded.select(F.col("code").alias("earlier"), F.col("lines").alias("before"))
    gone = (
        pairs.join(later, "later").join(earlier, "earlier").select("key", "lines", "sizes", "before")
        .mapInArrow(_align(min_block), "key string, gone array<int>")
        .groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    )
    # Cut here too: rows of one text, however many, meet their class in a join that can be split.
    of_class = durable(classes.select("key", "first", F.size("lines").alias("n_lines"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x).alias("chars")).join(gone, "key", "left"))
    every = F.sequence(F.lit(0), F.col("n_lines") - 1)
    whole = (F.col("id") > F.col("first")) & (F.col("chars") >= min_block)
    return rows.select("id", "key").distinct().join(of_class, "key").select(
        "id", "key", "n_lines", F.when(whole, every).when(F.col("id") == F.col("first"), F.col("gone")).alias("gone"))


def _without_blocks(docs: DataFrame, id_col: str, text: str, **more) -> DataFrame:
    """``docs`` with common blocks deleted, and ``__n_lines`` and ``__n_removed``."""
    marks = mark_common_lines(docs, id_col, text, **more).select(
        F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("n_lines").cast("long").alias("__n_lines"), F.col("gone").alias("__gone"))
    rows = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("__key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    stay = F.array_except(F.sequence(F.lit(0), F.col("__n_lines").cast("int") - 1), "__gone")
    # The split text is bound to a variable, so that it is made once and not for every line.
    left = F.get(F.transform(F.array(F.split(F.col(text), "\n")), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")), F.lit(0))
    return (
        rows.join(marks, ["__id", "__key"], "left")
        .withColumn(text, F.when(F.size("__gone") > 0, left).otherwise(F.col(text)))
        .withColumn("__n_removed", F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long"))
        .drop("__id", "__key", "__gone")
    )


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with common blocks deleted from ``text``, and ``n_lines``, ``n_removed``."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _without_blocks(docs, id_col, text, **more).select(*own, F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def keep_distinct_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: blocks go; a document that loses all its lines goes too."""
    out = _without_blocks(docs, "doc_id", "text")
    return out.filter("__n_removed = 0 or __n_removed < __n_lines").select(*docs.columns)
