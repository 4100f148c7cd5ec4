import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates, near_links


def brute_print(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    """prints: list of (id, fingerprint); smallest id reachable, by repeated passes."""
    comp = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if bin(a ^ b).count("1") <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return comp


def texts(n=70, seed=1):
    r = random.Random(seed)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randint(0, 40)) for _ in range(120)) for _ in range(8)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "One two"), (n + 4, "ONE\x0btwo"), (n + 5, "a b c d")]


def test_fingerprint_against_brute_force():
    for _, t in texts():
        assert fingerprint((t or "").encode()) == brute_print(t)


def test_near_duplicates_against_brute_force(spark):
    rows = texts()
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    comp = brute_components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", comp[i]) for i, p in prints}


def _linked(spark, prints, **more):
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints], "node long, fp long")
    links = [(r["a"], r["b"]) for r in near_links(df, **more).collect()]
    comp = {i: i for i, _ in prints}
    for _ in range(len(prints)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    by = dict(prints)
    assert all(bin(by[a] ^ by[b]).count("1") <= 64 for a, b in links)
    return comp


def test_large_cells_split_and_tile_without_loss(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 63, 6)
    prints = set()
    while len(prints) < 260:
        p = int(r.choice(centres))
        for b in r.integers(0, 64, r.integers(0, 6)):
            p ^= 1 << int(b)
        prints.add(p)
    prints = list(enumerate(sorted(prints)))
    want = brute_components(prints)
    assert _linked(spark, prints, cell_rows=10_000) == want
    assert _linked(spark, prints, cell_rows=16) == want
    assert _linked(spark, prints, cell_rows=16, depth=1) == want


def test_empty_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (3, "x y z")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(g) for g in got] == [(1, 1), (1, 1), (3, 3), (None, 1)]


def test_drop_keeps_one_and_extra_columns(spark):
    rows = [(i, t, "fp", i) for i, t in texts()]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, node int")
    kept = drop_near_duplicates(df, width=4)
    assert kept.columns == df.columns
    comp = brute_components([(i, brute_print(t)) for i, t, _, _ in rows])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(comp.values()))


def test_pivots_never_discard_a_true_pair():
    r = np.random.default_rng(2)
    fp = r.integers(0, 1 << 63, 300).astype(np.uint64)
    fp[100:200] = fp[:100] ^ np.uint64(0b1011)
    table = np.bitwise_count(fp[:, None] ^ simhash.reference_fingerprints(24)[None, :]).astype(np.uint8)
    got = {(a, b) for x, y in simhash.close_pairs(fp, table, 4) for a, b in zip(x.tolist(), y.tolist())}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if bin(int(fp[i] ^ fp[j])).count("1") <= 4}


def test_rows_without_id_and_repeated_ids_link_like_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width=4: int(text))
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.withColumn("fp", docs["text"].cast("long")))
    a, b, c, far = 0, 0b1111, 0b11111111, 0xFFFFFFFF
    rows = [(7, a), (None, b), (5, c), (9, far), (9, a), (None, 0xFFFF0000FFFF), (None, b)]
    got = near_duplicates(spark.createDataFrame([(i, str(p), "x", "y") for i, p in rows], "doc_id long, text string, fp string, node string")).collect()
    want = [(i, {a: 5, b: 5, c: 5, far: 9}.get(p)) for i, p in rows]
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    got = {r["doc_id"]: r["fingerprint"] for r in near_duplicates(spark.createDataFrame([(1, long), (2, long + " x")], "doc_id long, text string")).collect()}
    assert got[1] == f"{brute_print(long):016x}"
