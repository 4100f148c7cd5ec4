import random

import numpy as np

import corpus_pipeline
from tessera.llm import similar


def brute(rows, width=5):
    """Smallest id reachable over pairs of Jaccard 0.8 or more, from sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    near = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    comp = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return set(comp.values())


def texts(n=160, seed=3):
    """Copies with none to seven words changed of each base: similarity 0.5 to 1."""
    r = random.Random(seed)
    base = [" ".join(f"w{r.randint(0, 900)}" for _ in range(150)) for _ in range(12)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"changed{r.randint(0, 99)}"
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "One two"), (n + 3, "ONE\ttwo"), (n + 4, "a b c d e"), (n + 5, "a b c d f")]


def test_stage_drops_what_jaccard_says(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    want = brute(rows)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    tiled = similar.drop_similar(df, cell_rows=3)
    assert sorted(r["doc_id"] for r in tiled.collect()) == sorted(want)


def test_bucket_links_compare_all_pairs():
    a, b, c = np.arange(0, 100), np.arange(8, 108), np.arange(16, 116)
    assert similar.bucket_links([1, 2, 3], [x.astype(np.uint64) for x in (a, c, b)], [0, 0, 0]) == [(0, 2), (1, 2)]
    assert similar.bucket_links([1, 2, 3], [x.astype(np.uint64) for x in (a, b, c)], [0, 1, 1]) == [(0, 1)]


def test_empty_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (3, "x y z")], "doc_id long, text string")
    assert sorted((r["doc_id"] for r in similar.drop_similar(df).collect()), key=str) == [1, 3, None]
    assert similar.drop_similar(df.limit(0)).count() == 0


def differing(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def test_prints_are_majorities_and_cells_the_nearest_pivots():
    r = np.random.default_rng(5)
    one, two = (r.integers(0, 1 << 64, 1, dtype=np.uint64) for _ in range(2))
    many = r.integers(0, 1 << 64, 601, dtype=np.uint64)
    bits = lambda x: np.unpackbits(x.view(np.uint8), bitorder="little")
    votes = sum(bits(similar.prints(many[k : k + 1], 3)).astype(int) for k in range(len(many)))
    assert (bits(similar.prints(many, 3)) == (2 * votes > len(many))).all()
    assert not (bits(similar.prints(np.concatenate([one, two]), 3)) & ~bits(similar.prints(one, 3))).any()
    refs = r.integers(0, 1 << 64, (2, 50), dtype=np.uint64)
    found = similar.prints(many, 3)
    for k, cells in enumerate(similar.pivot_cells(found, refs, 4).reshape(3, 4)):
        ranked = sorted(range(50), key=lambda p: (differing(found[k], refs[:, p]), p))
        assert {int(c) for c in cells} == {50 * k + p for p in ranked[:4]}


def test_pairs_at_the_threshold_share_a_cell_and_lie_within_the_radius():
    r = np.random.default_rng(6)
    refs = similar.reference_fingerprints(8192).reshape(2, 4096)
    for common, left, right in [(240, 30, 30), (240, 60, 0), (40, 5, 5), (8, 1, 1)] * 25:
        x = r.integers(0, 1 << 64, common + left + right, dtype=np.uint64)
        ends = [similar.prints(s, 18) for s in (x[: common + left], np.concatenate([x[:common], x[common + left :]]))]
        cells = [similar.pivot_cells(p, refs, 4).reshape(18, 4).tolist() for p in ends]
        assert any(set(cells[0][k]) & set(cells[1][k]) and differing(ends[0][(k + 1) % 18], ends[1][(k + 1) % 18]) <= 40 for k in range(18))


def test_close_groups_against_all_pairs():
    r = np.random.default_rng(7)
    base = r.integers(0, 1 << 64, (6, 2), dtype=np.uint64)
    n = 300
    pick, cell, size = r.integers(0, 6, n), r.integers(0, 9, n), r.choice([10, 12, 13, 16, 30], n)
    flips = np.packbits(r.random((n, 128)) < 0.1, axis=1).view(np.uint64)
    words = base[pick] ^ flips
    order = np.lexsort((size, cell))
    cell, size, words = cell[order], size[order], words[order]
    want = list(range(n))
    for _ in range(n):
        before = list(want)
        for i in range(n):
            for j in range(i):
                if cell[i] == cell[j] and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]) and differing(words[i], words[j]) <= 25:
                    want[i] = want[j] = min(want[i], want[j])
        if want == before:
            break
    top = similar.close_groups(cell, size, words[:, 0], words[:, 1], 25)
    assert len(set(zip(top.tolist(), want))) == len(set(want)) == len(set(top.tolist())) < n


def test_stage_links_only_what_its_fingerprints_bring_together(spark):
    rows = texts(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.drop_similar(df, cell_prints=2).collect()) == sorted(brute(rows))
    apart = {" ".join((t or "").lower().split()) for _, t in rows}
    assert similar.drop_similar(df, radius=-1).count() == len(apart) > len(brute(rows))


def bucket(n=120, seed=8):
    """Sizes and prints of sets around the threshold, from one base."""
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 64, 100, dtype=np.uint64)
    sets = []
    for _ in range(n):
        x = base.copy()
        at = r.choice(100, r.integers(0, 22), replace=False)
        x[at] = r.integers(0, 1 << 64, len(at), dtype=np.uint64)
        sets.append(np.unique(x[: r.integers(84, 101)]))
    return sets, np.array([len(x) for x in sets]), np.array([similar.prints(x, 18).ravel() for x in sets])


def near(size, found, i, j):
    small, large = sorted((size[i], size[j]))
    return 4 * large <= 5 * small and differing(found[i], found[j]) <= similar.limits(np.array(small), 18)


def joined(n, pairs):
    top = list(range(n))
    for i, j in pairs:
        a, b = top[i], top[j]
        top = [a if t == b else t for t in top]
    return {frozenset(k for k in range(n) if top[k] == t) for t in top}


def test_similar_sets_are_candidates_and_spanning_pairs_connect_them():
    sets, size, found = bucket()
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if near(size, found, i, j)]
    same = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    alike = {(i, j) for i in range(n) for j in range(i) if 9 * same(i, j) >= 4 * (size[i] + size[j])}
    assert alike <= set(pairs) and 100 < len(alike) < len(pairs) < n * (n - 1) // 2
    got = similar.spanning_pairs(size, found)
    assert all(near(size, found, i, j) for i, j in got)
    assert joined(n, got) == joined(n, pairs) and len(got) == n - len(joined(n, pairs))


def test_crossing_pairs_are_the_nearest_and_all_in_the_end():
    _, size, found = bucket(60)
    comp = np.random.default_rng(9).integers(0, 25, 60)
    want = sorted((differing(found[i], found[j]), i, j) for j in range(60) for i in range(j) if comp[i] != comp[j] and near(size, found, i, j))
    for held in (1, 50, 1 << 20):
        i, j, more = similar.crossing_pairs(size, found, comp, len(want), held)
        assert sorted(zip(i, j)) == sorted(x[1:] for x in want) and not more
        i, j, more = similar.crossing_pairs(size, found, comp, 2, held)
        few = {x[1:] for c in set(comp.tolist()) for x in [x for x in want if c in (comp[x[1]], comp[x[2]])][:2]}
        assert set(zip(i.tolist(), j.tolist())) == few and more


def test_rows_grow_with_the_members_of_a_group_not_with_their_square(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    r = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in r.sample(range(150), r.randint(2, 6)):
            w[k] = f"changed{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain, read = DataFrame.mapInArrow, []

    def counted(self, func, schema, *more):
        if schema == "a long, b long":
            read.append(self.count())
        return plain(self, func, schema, *more)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    got = similar.drop_similar(df, cell_rows=8)
    assert sorted(x["doc_id"] for x in got.collect()) == sorted(brute(rows))
    assert read and max(read) <= 18 * 4 * len(rows)


def test_ids_too_many_to_send_give_the_same_rows(spark, monkeypatch):
    rows = texts(60) + [(3, "repeated"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda out: sorted(str(x["doc_id"]) for x in out.collect())
    sent = key(similar.drop_similar(df))
    monkeypatch.setattr(similar, "SENT", 0)
    assert key(similar.drop_similar(df)) == sent
