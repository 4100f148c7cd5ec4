"""Secret scan: named patterns, and strings that the tokenizer finds inefficient.

Base kinds, leftmost and non-overlapping within a kind:

* ``assign``: a key name (any case), ``:`` or ``=``, and a value of 6 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 20 characters or more;
* ``hex``: lower-case hex digits, 24 or more.

The method adds ``random``: a run of at least ``min_chars`` characters of the base64 and
base64url alphabets whose characters per token are at most ``max_ratio``. Random strings of
20 characters or more have 1.1 to 1.9 under the vocabulary (lower-case letters alone most),
words and names of one case over 2; the default lies between. Left out are

* known digests and numbers: hex of the usual digest lengths, UUIDs, integrity digests with
  their algorithm's name in front, digits only;
* identifiers, by structure: cut at signs, digits and changes of case, ``word_share`` of
  their letters stand in pieces of three letters or more that the vocabulary knows as words
  (``word_ratio`` characters per token or more); serials and dates, which are mostly digits
  between signs; and sequences, in which most characters follow the last one by one step;
* runs that touch a base span.

Null and empty text has no spans. Texts of any length are scanned whole, in time linear in
the text. Every row stands alone: repeated rows give repeated results, an empty table an empty
one; other columns pass through (``out`` replaces a column of its name). Offsets are code
points, end exclusive. Spans that start together are listed by kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.bpe import coder

# The kinds in their order of listing.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
INTEGRITY = re.compile(r"(?:md5|sha1|sha224|sha256|sha384|sha512)[-_]", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARK = re.compile(r"[+/_=-]+")
SLICE = 512
HINTS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def known(run: str) -> bool:
    """Digests, UUIDs and numbers."""
    return bool(UUID.fullmatch(run) or DIGEST.fullmatch(run) or INTEGRITY.match(run) or not re.search("[A-Za-z]", run))


def identifier(run: str, encode, word_share: float = 0.6, word_ratio: float = 2.2) -> bool:
    """Names, paths, serials and sequences, by their structure."""
    letters = sum(c.isalpha() for c in run)
    digits = sum(c.isdigit() for c in run)
    if len(MARK.findall(run)) > 1 and digits >= 0.6 * (letters + digits):
        return True
    steps = Counter(ord(b) - ord(a) for a, b in zip(run, run[1:]))
    if abs(steps.most_common(1)[0][0]) <= 1 and 2 * steps.most_common(1)[0][1] > len(run):
        return True
    words = (m.group().lower() for m in PIECE.finditer(run))
    return sum(len(w) for w in words if len(w) > 2 and len(w) >= word_ratio * n_tokens(" " + w, encode)) >= word_share * letters


def n_tokens(run: str, encode) -> int:
    """Tokens of a run, counted in slices, so that very long runs take linear time."""
    return sum(len(encode(run[k : k + SLICE])) for k in range(0, len(run), SLICE))


def random_spans(text: str, encode, min_chars: int = 20, max_ratio: float = 1.9) -> list[tuple[int, int, str]]:
    found = []
    for m in RUN.finditer(text):
        run = m.group()
        if len(run) >= min_chars and len(run) <= max_ratio * n_tokens(run, encode) and not known(run) and not identifier(run, encode):
            found.append((m.start(), m.end(), "random"))
    return found


def spans(text: str | None, encode, min_chars: int = 20, max_ratio: float = 1.9) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    out, k, reach = list(base), 0, 0
    for a, b, kind in random_spans(text, encode, min_chars, max_ratio):
        # ``reach``: where the base spans that start before a end; the next one must start after b.
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= a and (k == len(base) or base[k][0] >= b):
            out.append((a, b, kind))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "secrets",
         min_chars: int = 20, max_ratio: float = 1.9) -> DataFrame:
    """``docs`` with an array of struct(kind, start, end) per row."""

    @pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = coder(path, pattern).encoding.encode_ordinary
        for part in parts:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for a, b, k in spans(x, encode, min_chars, max_ratio)] for x in part], dtype=object)

    return docs.withColumn(out, find(F.col(text)))
