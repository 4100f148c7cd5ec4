import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=900, d=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, d))
    x = centres[r.integers(0, 8, n)] + 0.6 * r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if n > 50:
        x[5] = x[50]  # a tie
    return [(i, [float(v) for v in row.astype(np.float32)], 0) for i, row in enumerate(x)]


BAD = [(2000, None, 0), (2050, [], 0), (2100, [0.0] * 16, 0), (2150, [float("nan")] + [0.1] * 15, 0), (2200, [None] + [0.1] * 15, 0), (2250, [float("inf")] + [0.1] * 15, 0), (2300, [0.1] * 3, 0)]


def test_topk_against_brute_force(spark):
    data = rows() + BAD
    got = {}
    for r in topk.top_products(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [math.floor(256 * v) for v in e] for i, e, _ in data if e and len(e) == 16 and all(v is not None and math.isfinite(v) for v in e)}
    for q in [i for i in ints if i % 50 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q))[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not got


def test_topk_exact_on_large_and_equal_values(spark):
    big = [(i, [float(2**20 + (i * 7) % 5), float(-(2**20)), 3.0], 0) for i in range(60)]
    out = topk.top_products(spark.createDataFrame(big, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    ints = {i: [math.floor(256 * v) for v in e] for i, e, _ in big}
    for q in (0, 50):
        want = sorted(((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q))[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_nearest_recall_and_scores(spark):
    data = rows(1500) + BAD
    out = ann.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0).collect()
    good = {i: np.array(e, float) for i, e, _ in data if e and len(e) == 16 and all(v is not None and math.isfinite(v) for v in e) and any(e)}
    hits = total = 0
    for q in [i for i in good if i % 100 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        assert all(abs(s - np.linalg.norm(good[i] - good[q])) < 1e-12 for _, i, s in mine)
        best = sorted((float(np.linalg.norm(good[i] - good[q])), i) for i in good if i != q)[:10]
        hits += len({i for _, i in best} & {m[1] for m in mine})
        total += 10
    assert hits / total >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame(rows(4), SCHEMA)
    assert ann.nearest(few, F.col("vec_id") == 0).count() == 3
    assert topk.top_products(few, F.col("vec_id") == 0).count() == 3
    none = spark.createDataFrame(BAD[:2], SCHEMA)
    assert ann.nearest(none, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_products(none, F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_values_beyond_64_bits_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    values = [[float(v) for v in r.normal(size=4) * 10.0 ** r.integers(0, 17)] for _ in range(80)] + [[1e200, -1e200, 1.0, 1.0], [1e200, 1e200, 1.0, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    ints = [[math.floor(256 * x) for x in v] for v in values]
    most = (1 << 63) - 1
    got = {}
    for x in topk.top_products(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for q in range(0, 82, 10):
        score = {i: max(-most - 1, min(most, sum(a * b for a, b in zip(ints[q], ints[i])))) for i in range(82) if i != q}
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]


def test_repeated_ids_and_clashing_columns(spark):
    data = [(i, v, 1.0, [1.0], 9) for i, v, _ in rows(120)]
    df = spark.createDataFrame(data + data[:30], "vec_id long, embedding array<float>, score double, v array<double>, rank int")
    for out in (ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect(), topk.top_products(df, F.col("vec_id") % 50 == 0).collect()):
        assert {x["query_id"] for x in out} == {0, 50, 100} and all(x["vec_id"] != x["query_id"] for x in out)


def test_recall_with_production_settings_does_not_depend_on_the_batch_size(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {x["vec_id"]: np.array(x["embedding"], float) for x in df.collect()}
    ids = np.array(sorted(vectors))
    every = np.stack([vectors[i] for i in ids])
    found = []
    for size in ("10000", "300"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append(sorted(tuple(x) for x in ann.nearest(df.coalesce(1), F.col("vec_id") % 100 == 0).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        dist = np.linalg.norm(every - vectors[q], axis=1)
        dist[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, dist))[:10]].tolist())
        hits, total = hits + len(best & {x[2] for x in found[0] if x[0] == q}), total + 10
    assert hits / total >= 0.9
