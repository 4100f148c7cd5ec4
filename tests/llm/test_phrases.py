import hashlib
import random

import numpy as np

from tessera.llm.phrases import remove_repeats


def brute(rows, length=100):
    """Spec, byte by byte: rows in order of (id, text)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        b = (text or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int), [0]])) == 1).sum())
        rest = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), int(cover.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 60)) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 30) :])
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[7][1]) for i in range(5)] + [(200, "x" * 700), (201, ("ab" * 90) + text(9)), (202, None), (203, ""), (204, "short")]
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = remove_repeats(df, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(x) for x in out), key=str)


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_hot_triggers_give_the_same(spark):
    rows = corpus(5)
    assert got(spark, rows, group_rows=2) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = corpus(6)[:20] + corpus(6)[:4] + [(None, corpus(6)[2][1])]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_kept_text(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "abc " * 60, 5), (2, "abc " * 60, 6)], "doc_id long, text string, doc int").select("doc_id", "text")
    out = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeats(df, keep_text=True).collect()}
    assert out[2] == b"" and len(out[1]) == 4
