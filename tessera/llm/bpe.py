"""Byte-level BPE as a monoid: encode halves, join neighbours, decode up the tree.

A text is halved until a leaf has at most ``LEAF`` characters; a leaf is encoded by the
tokenizer itself. Two neighbours join by re-encoding a window around the border. The
window grows on each side until it ends at a *fixed border*: a place where the pattern
must cut whatever stands before and after it (a change from non-space to white space,
from letter to non-letter, from number to non-number, or from punctuation to number).
No match of the pattern spans such a place, no look-ahead crosses it, and matching keeps
no memory, so the tokens outside are proven to be those of the joined text. If a side has
no such place, the window takes the whole side.

Null text counts as empty text (no ids). Very long texts need no special case; ties do
not arise; other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

LEAF, WINDOW = 2048, 48
FIXED = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])|(?<=[^\s\p{L}\p{N}])(?=\p{N})"
)


class TreeCoder:
    """Encoder and decoder over one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self.width = np.zeros(size, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        short = 16
        self.short = short
        self.token = [b""] * size
        self.bytes_of = np.zeros((size, short), np.uint8)
        for token, i in ranks.items():
            self.token[i] = token
            head = token[:short]
            self.bytes_of[i, : len(head)] = np.frombuffer(head, np.uint8)
        self.used = np.arange(short) < self.width[:, None]
        digits = [f"{i},".encode() for i in range(size)]
        most = max(map(len, digits))
        self.digit = np.zeros((size, most), np.uint8)
        for i, d in enumerate(digits):
            self.digit[i, : len(d)] = np.frombuffer(d, np.uint8)
        self.digit_used = np.arange(most) < np.array([len(d) for d in digits])[:, None]

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)

    def _skip(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading ids cover exactly n_bytes."""
        take = min(len(ids), n_bytes)
        ends = np.cumsum(self.width[ids[:take]])
        k = int(np.searchsorted(ends, n_bytes))
        return 0 if n_bytes == 0 else k + 1

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of left + right from the ids of each."""
        if not left or not right:
            return b if not left else a
        size, p = WINDOW, 0
        while True:
            lo = max(0, len(left) - size)
            cuts = [m.start() for m in FIXED.finditer(left, lo)]
            if cuts or lo == 0:
                p = cuts[-1] if cuts else 0
                break
            size *= 4
        size, q = WINDOW, len(right)
        while True:
            hi = min(len(right), size)
            m = FIXED.search(right[: hi + 1])
            if m or hi == len(right):
                q = m.start() if m else len(right)
                break
            size *= 4
        tail, head = left[p:], right[:q]
        drop = self._skip(a[::-1], len(tail.encode("utf-8", "surrogatepass")))
        skip = self._skip(b, len(head.encode("utf-8", "surrogatepass")))
        return np.concatenate([a[: len(a) - drop], self.leaf(tail + head), b[skip:]])

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > LEAF:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if (self.width[ids] > self.short).any():
            return b"".join([self.token[i] for i in ids.tolist()])
        return self.bytes_of[ids][self.used[ids]].tobytes()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.digit[ids][self.digit_used[ids]][:-1].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> TreeCoder:
    return TreeCoder(path, pattern)


def tokenize(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text",
             ids: bool = True, digests: bool = False) -> DataFrame:
    """(id, n_tokens[, ids][, ids_sha256, decoded_sha256]) for each row of ``docs``.

    ``path`` is the rank file, which every machine has in the same place; each worker
    reads it once. ``decoded_sha256`` is of the bytes that decoding the ids gives.
    """
    schema = f"{id_col} long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                lengths, arrays, sums, backs = [], [], [], []
                for value in part.column(1):
                    found = c.encode(value.as_py() or "")
                    lengths.append(len(found))
                    if ids:
                        arrays.append(found.astype(np.int32))
                    if digests:
                        sums.append(hashlib.sha256(c.digits(found)).hexdigest())
                        backs.append(hashlib.sha256(c.decode(found)).hexdigest())
                columns = [part.column(0), pa.array(lengths, pa.int64())]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                columns += [pa.array(sums), pa.array(backs)] if digests else []
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).alias("text")).mapInArrow(run, schema)


def detokenize(coded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``coded`` with the bytes that its ids decode to (null ids: empty)."""

    @pandas_udf("binary")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = coder(path, pattern)
        for part in parts:
            yield part.map(lambda x: c.decode(np.asarray(x if x is not None else [], np.uint32)))

    return coded.withColumn(out, back(F.col(ids)))
