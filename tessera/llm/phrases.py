"""Repeated-substring removal by prefix-free parsing.

A rolling hash of every ``GRAM``-byte string picks *triggers*: in each window of
``length`` bytes the gram with the smallest hash (leftmost on a tie). Consecutive windows
with the same trigger make a *phrase*: the bytes those windows cover, overlapping the
next phrase, so that every window lies in exactly one phrase. Which trigger a window has
depends on its bytes alone, so equal windows share a trigger.

The dictionary of distinct phrases (trigger, phrase digest) is found with one aggregation
that keeps the earliest occurrence of each. Then

* an occurrence that is not the earliest of its phrase holds only repeated windows;
* the earliest occurrence of a phrase whose trigger no other phrase has holds none;
* what is left, phrases that share a trigger, is resolved exactly by the suffix order of
  those phrases: their suffixes, cut at ``length`` bytes, are sorted, equal ones make one
  class, and the earliest member of a class stays.

Windows never cross documents. Order is (id, start); null ids come first, and documents
that share an id are ordered by text. Null text counts as empty; texts shorter than
``length`` are untouched.
"""

from __future__ import annotations


import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable

GRAM = 24
PIECE = 1 << 19
SPAN_BITS = 7
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
LOW = np.uint64((1 << 24) - 1)


def _rolling(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each position."""
    n = len(buf)
    words = np.empty(n - 7, np.uint64)
    for r in range(8):
        words[r::8] = buf[r : r + (n - r) // 8 * 8].view("<u8")
    m = n - GRAM + 1
    h = words[:m] * MIX[0]
    for k in range(1, GRAM // 8):
        h += words[8 * k : 8 * k + m] * MIX[k]
    h ^= h >> np.uint64(29)
    h *= MIX[3]
    h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (block prefix and suffix minima)."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def parse(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the texts buf[starts[i]:ends[i]]: text number, first window, number of
    windows, trigger hash. At most 2^24 bytes."""
    none = np.zeros(0, np.int64)
    long = ends - starts >= length
    if not long.any():
        return none, none, none, none.astype(np.uint64)
    h = _rolling(buf)
    tagged = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
    low = _window_min(tagged, length - GRAM + 1)
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = np.ones(len(low), bool)
    new[1:] = low[1:] != low[:-1]
    new[starts[long]] = True
    first = np.flatnonzero(valid & new)
    text = np.searchsorted(starts, first, side="right") - 1
    stop = ends[text] - length + 1
    stop[:-1] = np.minimum(stop[:-1], first[1:])
    return text, first, stop - first, h[(low[first] & LOW).astype(np.int64)]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[int], list[int], list[int]]]:
    """Batches (buffer, text number, start in buffer, offset in text) of bounded size. A
    text above PIECE bytes is cut with an overlap of length - 1, so no window is lost."""
    buf, who, at, off, size = [], [], [], [], 0
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[o : o + PIECE + length - 1] if len(t) > PIECE else t
            buf.append(part), who.append(i), at.append(size), off.append(o)
            size += len(part)
            if size >= PIECE:
                yield b"".join(buf), who, at, off
                buf, who, at, off, size = [], [], [], [], 0
    if size >= GRAM:
        yield b"".join(buf), who, at, off


def phrases(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, text number, start in text, windows, trigger, start in buffer) by batch."""
    for data, who, at, off in _pieces(texts, length):
        buf = np.frombuffer(data, np.uint8)
        starts = np.array(at, np.int64)
        ends = np.append(starts[1:], len(data))
        k, first, n, trigger = parse(buf, starts, ends, length)
        if len(k):
            yield data, np.array(who)[k], first - starts[k] + np.array(off, np.int64)[k], n, trigger, first


def _numbered(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """(``doc``, ``id``, ``t``) with a unique, ordered document number, and the bits that a
    byte position needs. Ids number themselves unless they repeat, are null or too wide."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    seen = rows.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.octet_length("t")).alias("most"),
                    F.count(F.lit(1)).alias("n"), F.count("id").alias("ids")).first()
    bits = SPAN_BITS + max(1, int(seen["most"] or 0).bit_length())
    plain = seen["n"] == seen["ids"] and (not seen["n"] or (seen["hi"] - seen["lo"]).bit_length() + bits <= 62)
    if plain and not rows.groupBy("id").count().filter("count > 1").limit(1).count():
        return rows.select((F.col("id") - F.lit(seen["lo"] or 0)).alias("doc"), "id", "t"), bits
    ordered = durable(rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
                      .withColumn("m", F.monotonically_increasing_id()))
    width = int(ordered.agg(F.max(F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("w")).first()["w"] or 0).bit_length()
    part, row = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.select(F.shiftleft(part, width).bitwiseOR(row).alias("doc"), "id", "t"), bits


def _emit(length: int):
    """mapInArrow (doc, t) -> phrases, each once per batch with its earliest occurrence."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, out = batch.column(0).to_numpy(), batch.column(1).to_pylist(), []
            for data, who, pos, n, trigger, first in phrases(texts, length):
                view = memoryview(data)
                whole = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + (length - 1)).tolist())], np.uint64)
                out.append((trigger, whole, docs[who], (pos << SPAN_BITS) | (n - 1)))
            if not out:
                continue
            trigger, whole, doc, pos = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((pos, doc, whole, trigger))
            trigger, whole = trigger[order], whole[order]
            new = np.ones(len(order), bool)
            new[1:] = (trigger[1:] != trigger[:-1]) | (whole[1:] != whole[:-1])
            order = order[new]
            yield pa.RecordBatch.from_arrays([pa.array(trigger[new].view(np.int64)), pa.array(whole[new].view(np.int64)), pa.array(doc[order]), pa.array(pos[order])],
                                             names=["trigger", "whole", "doc", "pos"])

    return run


def _spans(length: int, hot: bool):
    """mapInArrow (doc, id, t, todo) -> the bytes of listed phrases, or the digest of each of
    their windows for triggers with very many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns: list[list] = [[], [], [], []]
                for doc, text, todo in zip(*(part.column(c).to_pylist() for c in (0, 2, 3))):
                    for x in todo or ():
                        start, n = x["pos"] >> SPAN_BITS, (x["pos"] & ((1 << SPAN_BITS) - 1)) + 1
                        if not hot:
                            for c, v in zip(columns, (x["trigger"], doc, x["pos"], text[start : start + n + length - 1])):
                                c.append(v)
                            continue
                        for s in range(start, start + n):
                            whole = xxhash.xxh3_128_digest(text[s : s + length])
                            for c, v in zip(columns, (whole[:8], whole[8:], doc, s << SPAN_BITS)):
                                c.append(v)
                if not columns[0]:
                    continue
                if hot:
                    arrays = [pa.array(np.frombuffer(b"".join(c), "<i8")) for c in columns[:2]] + [pa.array(c, pa.int64()) for c in columns[2:]]
                    yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "doc", "pos"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.binary())], names=["trigger", "doc", "pos", "span"])

    return run


def first_windows(members: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """Runs (doc, pos) of windows that no earlier phrase of the same trigger holds.

    The suffixes of all member phrases, cut at ``length`` bytes, are put in suffix order;
    of equal neighbours the earliest (doc, start) is first.
    """
    suffixes = sorted((span[i : i + length], doc, (pos >> SPAN_BITS) + i) for doc, pos, span in members for i in range(len(span) - length + 1))
    kept, was = [], None
    for window, doc, start in suffixes:
        if window != was:
            kept.append((doc, start))
            was = window
    kept.sort()
    runs: list[tuple[int, int]] = []
    most = 1 << SPAN_BITS
    at_doc, at, n = None, 0, 0
    for doc, start in kept:
        if doc == at_doc and start == at + n and n < most:
            n += 1
            continue
        if n:
            runs.append((at_doc, (at << SPAN_BITS) | (n - 1)))
        at_doc, at, n = doc, start, 1
    if n:
        runs.append((at_doc, (at << SPAN_BITS) | (n - 1)))
    return runs


def _resolve(length: int):
    """mapInArrow over phrases sorted by trigger -> runs of first windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, out = None, [], []
        for batch in batches:
            for trigger, doc, pos, span in zip(*(c.to_pylist() for c in batch.columns)):
                if trigger != at:
                    out += first_windows(members, length)
                    at, members = trigger, []
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "pos"])
                        out = []
                members.append((doc, pos, span))
        out += first_windows(members, length)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "pos"])

    return run


def removed_runs(n_bytes: int, kept: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes that repeated windows cover, given the runs of
    windows that are first."""
    n = n_bytes - length + 1
    if n <= 0:
        return []
    kept = np.sort(kept)
    start, stop = kept >> SPAN_BITS, (kept >> SPAN_BITS) + (kept & ((1 << SPAN_BITS) - 1)) + 1
    a, b = np.concatenate([[0], stop]), np.concatenate([start, [n]])
    gap = a < b
    a, b = a[gap], b[gap] + length - 1
    if not len(a):
        return []
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return list(zip(a[first].tolist(), b[last].tolist()))


def _cut(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for j, (i, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    lists = [part.column(c)[j] for c in (2, 3)]
                    kept = np.concatenate([x.values.to_numpy() for x in lists if x.is_valid] or [np.zeros(0, np.int64)])
                    runs = removed_runs(len(text), kept, length)
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((i, len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if keep_text else [{"start": a, "end": b} for a, b in runs]))
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept" if keep_text else "spans"]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary() if keep_text else pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100,
                   group_rows: int = 32, keep_text: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 and either the
    removed ``spans`` or, with ``keep_text``, the bytes left in ``kept``.

    Triggers with more than ``group_rows`` phrases are resolved by digests of their
    windows in one aggregation instead of one group each; the result is the same.
    """
    if not GRAM <= length < GRAM + (1 << SPAN_BITS):
        raise ValueError(f"length must be from {GRAM} to {GRAM + (1 << SPAN_BITS) - 1}")
    rows, bits = _numbered(docs, id_col, text)
    mask = F.lit((1 << bits) - 1)
    loc = F.shiftleft("doc", bits).bitwiseOR(F.col("pos")).alias("loc")
    at = F.shiftright("loc", bits).alias("doc")

    found = rows.select("doc", "t").mapInArrow(_emit(length), "trigger long, whole long, doc long, pos long").select("trigger", "whole", loc)
    # Dealt by trigger alone: the aggregation and the count below need no further shuffle.
    dictionary = found.repartition("trigger").groupBy("trigger", "whole").agg(F.min("loc").alias("loc"))
    shared = dictionary.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("trigger")))
    listed = shared.select(at, F.col("loc").bitwiseAND(mask).alias("pos"), F.when(F.col("n") > 1, F.col("trigger")).alias("trigger"),
                           (F.col("n") > group_rows).alias("hot"))
    of_doc = listed.groupBy("doc").agg(
        F.collect_list(F.when(F.col("trigger").isNull(), F.col("pos"))).alias("clean"),
        F.collect_list(F.when(F.col("trigger").isNotNull(), F.struct("pos", "trigger", "hot"))).alias("todo"),
    )
    # The three readers of ``whole`` ask for the same columns of the texts, so that the
    # shuffle of the texts is made once and used again.
    whole = rows.join(of_doc, "doc", "left")
    pick = lambda hot: F.filter("todo", lambda x: x["hot"] if hot else ~x["hot"])
    # No filter here: it would turn the outer join into an inner one with another scan.
    text_of = lambda hot: F.when(F.size(pick(hot)) > 0, F.col("t")).alias("t")
    open_cold = whole.select("doc", "id", text_of(False), pick(False).alias("todo"))
    open_hot = whole.select("doc", "id", text_of(True), pick(True).alias("todo"))
    cold = (
        open_cold.mapInArrow(_spans(length, False), "trigger long, doc long, pos long, span binary")
        .repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_resolve(length), "doc long, pos long")
    )
    windows = open_hot.mapInArrow(_spans(length, True), "h1 long, h2 long, doc long, pos long").select("h1", "h2", loc)
    firsts = windows.groupBy("h1", "h2").agg(F.min("loc").alias("loc")).select(at, F.col("loc").bitwiseAND(mask).alias("pos"))
    resolved = cold.unionByName(firsts).groupBy("doc").agg(F.collect_list("pos").alias("more"))
    last = whole.select("doc", "id", "t", "clean").join(resolved, "doc", "left").select("id", "t", "clean", "more")
    tail = "kept binary" if keep_text else "spans array<struct<start:long,end:long>>"
    out = last.mapInArrow(_cut(length, keep_text), f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {tail}")
    return out.withColumnRenamed("id", id_col)
