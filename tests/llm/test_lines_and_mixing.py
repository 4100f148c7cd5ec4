import random

import numpy as np
import pytest

from tessera.llm import lines, mixing


def test_patience_is_a_common_subsequence():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ([r.randint(0, 9) for _ in range(r.randint(0, 14))] for _ in range(2))
        p = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert lines.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert lines.common_blocks([1, 2, 3, 4], [50, 60, 10, 60], [9, 1, 2, 8, 4], 100) == [0, 1]


LONG = [f"line number {i} of a text that is long enough to count for something" for i in range(12)]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    return {(r["doc_id"], r["gone"]): (r["text"], r["n_lines"], r["n_removed"]) for r in lines.drop_common_lines(df, **more).collect()}


def test_later_documents_lose_common_blocks(spark):
    a, b = "\n".join(LONG[:6]), "\n".join(["own line " * 9, *LONG[2:5], "tail " * 9])
    got = run(spark, [(1, a, "x"), (2, b, "x"), (3, a, "x"), (4, "short\nshort", "x"), (5, "short\nshort", "x"), (6, None, "x"), (7, "", "x"), (None, a, "x")])
    assert got[1, "x"] == (a, 6, 0)
    assert got[2, "x"] == ("\n".join(["own line " * 9, "tail " * 9]), 5, 3)
    assert got[3, "x"] == ("", 6, 6) and got[None, "x"] == ("", 6, 6)
    assert got[4, "x"] == got[5, "x"] == ("short\nshort", 2, 0)
    assert got[6, "x"][0] is None and got[7, "x"][0] == ""


def test_frequent_lines_still_pair_with_the_first(spark):
    shared = "\n".join(LONG[:3])
    rows = [(i, f"document {i} begins in its own way, like no other one does\n{shared}", "x") for i in range(30)]
    got = run(spark, rows)
    assert got[0, "x"][2] == 0 and all(got[i, "x"][2] == 3 for i in range(1, 30))


def test_repeated_rows_and_empty_table(spark):
    a = "\n".join(LONG[:4])
    df = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, "z" * 150, "z")], "doc_id long, text string, gone string")
    assert lines.drop_common_lines(df).count() == 3
    assert lines.keep_distinct_lines(df).columns == df.columns
    assert lines.drop_common_lines(df.limit(0)).count() == 0


def test_rates_match_numpy_and_targets(spark):
    r = np.random.default_rng(3)
    for sharp in (0.05, 0.3, 2.0):
        n = r.integers(10, 200, 400)
        p = r.dirichlet([sharp, sharp, sharp / 10], 400)
        df = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
        factors, ridge = [1.05, 0.5, 0.0], 0.02
        units, reached, goal = mixing.fit_rates(df, factors, ridge)
        share, centre = n / n.sum(), p @ np.array(factors)
        start = share @ p
        rate = centre.copy()
        for _ in range(5000):
            pull = ((rate * share) @ p - start * factors) / start
            rate = np.maximum(0, rate - (p @ pull + ridge * (rate - centre)) / (1 + ridge))
        got = np.array([x["rate"] for x in units.orderBy("doc_id").collect()])
        assert (got >= 0).all() and np.allclose(goal, start * factors) and np.allclose(reached, (got * share) @ p)
        assert (np.abs(reached - (rate * share) @ p) < 1e-5 * start).all() and np.abs(got - rate).max() < 1e-3


def test_targets_within_reach_are_met(spark):
    """Sharp posteriors and targets that documents can give: within one per cent."""
    r = np.random.default_rng(5)
    kind, n = r.integers(0, 3, 3000), r.integers(10, 200, 3000)
    p = np.full((3000, 3), 1e-4)
    p[np.arange(3000), kind] = 1 - 2e-4
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    _, reached, goal = mixing.fit_rates(df, [1.5, 0.5, 0.9])
    assert np.allclose(reached, goal, rtol=0.01)


def test_an_unsettled_fit_raises(spark):
    df = spark.createDataFrame([(1, 10, [0.6, 0.4]), (2, 10, [0.5, 0.5])], "doc_id long, n_tokens long, p array<double>")
    with pytest.raises(RuntimeError):
        mixing.fit_rates(df, [1.0, 0.0], tolerance=0.0, most=2)


def test_tokens_of_rows_that_share_an_id_are_added(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, " d e "), (None, "f"), (None, "g h"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["n_tokens"] for r in mixing.document_rates(df, labels).collect()}
    assert got == {1: 5, None: 3, 2: 0, 3: 0}


def test_classifier_against_counts_by_hand(spark):
    """Posteriors from the document counts of each word, one by one."""
    r = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêñóíç"
    vocab = {"q1_t0": [f"good{x}" for x in letters[:30]], "q0_t0": [f"poor{x}" for x in letters[:30]]}
    common = [f"word{x}" for x in letters]
    docs = [(i, d, " ".join(r.choice(vocab[d] + common, 25))) for i, d in enumerate(r.choice(list(vocab), 200))]
    df = spark.createDataFrame([(i, t) for i, _, t in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(d[1]), int(d[4])) for i, d, _ in docs], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["p"] for x in mixing.document_rates(df, labels).collect()}
    names = ["q0_t0", "q1_t0"]
    size = {d: sum(x == d for _, x, _ in docs) for d in names}
    words = sorted({w for _, _, t in docs for w in t.split()})
    seen = {(w, d): sum(w in t.split() and x == d for _, x, t in docs) for w in words for d in names}
    z = np.tile([np.log(size[d] / 200) for d in names], (200, 1))
    for w in words:
        every = sum(seen[w, d] for d in names) / 200
        if not any(seen[w, d] - every * size[d] > 4 * np.sqrt(every * size[d] + 1) and seen[w, d] >= 0.02 * size[d] for d in names):
            continue
        for k, d in enumerate(names):
            own, top = min(0.99, every * (seen[w, d] + 2) / (every * size[d] + 2)), min(0.99, every)
            z[:, k] += [np.log(own / top) if w in t.split() else np.log((1 - own) / (1 - top)) for _, _, t in docs]
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(np.array([got[i] for i, _, _ in docs]), want, atol=1e-6)


def test_mix_with_clashing_columns_and_a_long_text(spark):
    df = spark.createDataFrame([(i, "stone river " * (5 if i else 100_000), "a", 0.5, 3) for i in range(20)], "doc_id int, text string, __id string, __rate double, __copies int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    out = mixing.mix(df, labels, {"q1_t0": 1.0})
    assert out.columns == df.columns and out.count() == 20 and {r["__rate"] for r in out.collect()} == {0.5}


def test_mix_drops_toxic_and_keeps_clean(spark):
    words = ["stone river cloud", "bad awful nasty"]
    docs = [(i, " ".join([words[i % 5 == 0]] * 30), i) for i in range(100)] + [(200, None, 0), (201, "", 0), (None, "stone", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 0)) for i in range(0, 60)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    model = mixing.train(df, labels)
    assert model[0] == ["q0_t1", "q1_t0"]
    out = [x["doc_id"] for x in mixing.mix(df, labels, {"q1_t0": 1.05, "q0_t1": 0.0}).collect()]
    assert not [i for i in out if i is not None and i < 100 and i % 5 == 0]
    assert {i for i in range(100) if i % 5} <= set(out) and None in out
    assert mixing.mix(df, labels.limit(0)).count() == df.count()
    assert mixing.mix(df.limit(0), labels).count() == 0
