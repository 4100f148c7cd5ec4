"""Queries on small tables against brute force in plain Python, apart from their SQL."""

import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixel
from tessera.operators import graph, raster
from tessera.plans import catalog, fixtures


def test_region_graph_sees_every_order(spark, tmp_path):
    rows = [(o, s, 0.01 * (s % 5)) for o, sup in {1: (1, 2, 2), 49: (2, 3), 50: (3, 4), 51: (4, 1), 77: (5,)}.items() for s in sup]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    held = {}
    for o, s, _ in rows:
        held.setdefault(o, set()).add(s)
    want = sorted({p for s in held.values() for p in combinations(sorted(s), 2)})
    got = [tuple(r) for r in fixtures.region_graph(spark, str(tmp_path)).select("src", "dst").collect()]
    assert sorted(got) == want == [(1, 2), (1, 4), (2, 3), (3, 4)]
    assert [r["id"] for r in catalog.queries()["d09_isolated_regions"](spark, str(tmp_path)).collect()] == [5]


GRAPH = "d04_mergeable_edges d09_isolated_regions h21_region_edges h22_region_buckets h23_first_merge i03_lowest_bucket j01_insert_sorted k19_unordered_keys".split()


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Orders with repeated lines, equal means, keys below zero and nulls; one large order."""
    r = random.Random(3)
    rows = [(r.randint(1, 90), r.randint(-40, 60), 0.01 * r.randint(0, 10)) for _ in range(600)] + [(7, 5, 0.02)] * 300
    rows += [(200, s, 0.05) for s in range(70, 110)] + [(201, 300, 0.04), (201, 301, 0.04), (202, 302, 0.04), (None, 5, 0.01), (203, 303, None), (203, 304, 0.03)]
    d = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", GRAPH)
def test_region_graph_queries_as_in_sql(spark, lines, name, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{lines}/lineitem.parquet/*.parquet'")
    df = catalog.queries()[name](spark, lines)
    res = con.execute(catalog.oracle_sql()[name])
    want = sorted(map(repr, res.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*[c[0] for c in res.description]).collect()) == want and want


@pytest.mark.parametrize("make", [fixtures.region_graph, fixtures.region_pairs])
def test_tasks_of_the_region_graph_grow_with_the_table(spark, lines, make, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 50)
    assert make(spark, lines).rdd.getNumPartitions() == 19


def plan(spark, d, name):
    return catalog.queries()[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_make_the_graph_once(spark, lines):
    assert plan(spark, lines, "h22_region_buckets").count("Join ") == 3


@pytest.mark.parametrize("name", ["k19_unordered_keys", "d04_mergeable_edges", "j01_insert_sorted"])
def test_no_weights_where_none_are_asked_for(spark, lines, name):
    assert plan(spark, lines, name).count("Join ") == 1


@pytest.mark.parametrize("name", ["d09_isolated_regions", "h23_first_merge", "j01_insert_sorted"])
def test_no_distinct_edges_where_repeats_change_nothing(spark, lines, name):
    p = plan(spark, lines, name)
    assert "Aggregate [src#" not in p.replace("Aggregate [src#", "one:", 1 if name[0] == "j" else 0) and "ByExpression [src#" not in p


def test_means_go_to_lines_not_to_edges(spark, lines):
    """The edges are the last join."""
    for name in ("h21_region_edges", "i03_lowest_bucket"):
        joins = [x for x in plan(spark, lines, name).splitlines() if "Join " in x]
        assert "l_orderkey" in joins[0] and "src#" in joins[0] and len(joins) == 3


def test_boxes_cross_beyond_the_first_ids(spark, tmp_path):
    rows = [(i, [0.037 * (i % 17) - 0.3, 0.041 * (i % 23) - 0.4]) for i in range(100, 160)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    box = {i: (x, y, x + 0.2, y + 0.1) for i, (x, y) in rows}
    cross = lambda h, v: any(h[0] <= x <= h[2] and v[1] <= y <= v[3] for x in (v[0], v[2]) for y in (h[1], h[3]))
    want = {(i, j) for i in box for j in box if i < j and (cross(box[i], box[j]) or cross(box[j], box[i]))}
    got = {(r["a"], r["b"]) for r in catalog.queries()["e14_boxes_cross"](spark, str(tmp_path)).collect()}
    assert got == want and any(i >= 120 for i, _ in want)


def test_boxes_of_odd_vectors_cross_as_in_sql(spark, tmp_path):
    """Repeated ids, ties at a box's edge, vectors that are short, null or not finite."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.05 * (i % 11) - 0.25, 0.025 * (i % 13) - 0.15]) for i in range(80)] + [(i, [0.3, 0.1 * i]) for i in (3, 3, 4, 90, 90)]
    odd = [[nan, 0.1], [nan, 0.1], [nan, nan], [nan, nan], [inf, 0.0], [inf, 0.05], [-inf, 0.0], [0.1, -inf], [0.2, -inf], [1e300, 0.0], [1e300, 1.0], [-0.0, 0.0], [0.1], [], None, [None, 0.1]]
    rows += [(100 + i, v) for i, v in enumerate(odd)] + [(None, [0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = catalog.queries()["e14_boxes_cross"](spark, str(tmp_path))
    got, want = sorted(tuple(r) for r in df.select("a", "b").collect()), sorted(con.execute(catalog.oracle_sql()["e14_boxes_cross"]).fetchall())
    assert got == want and (100, 101) in want and (104, 105) in want
    # The pairs of ids that stand once are not gathered to be made distinct.
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_positions_are_ranks_over_all_partitions(spark):
    df = spark.range(0, 3000, 7).selectExpr("id * 31 % 2999 as k").distinct()
    got = {r["k"]: r["position"] for r in graph.positions(df, "k").collect()}
    assert [got[k] for k in sorted(got)] == list(range(len(got))) and len(got) == 429
    assert graph.positions(df.limit(0), "k").count() == 0


def test_random_values_are_those_of_the_c_library(spark):
    row = spark.createDataFrame([(1, 42)], "a int, b int").select(*[pixel.random_value(F.col(c), k).alias(f"{c}{k}") for c in "ab" for k in range(3)]).first()
    assert tuple(row) == (1804289383, 846930886, 1681692777, 71876166, 708592740, 1483128881)


def test_components_stay_in_a_frame_and_region(spark):
    rows = [(0, 1, 0, 0, 1, 10), (0, 1, 1, 2, 3, 11), (0, 1, 2, 3, 3, 12), (0, 1, 4, 3, 3, 13), (0, 2, 1, 0, 1, 14), (1, 1, 1, 0, 3, 15)]
    df = spark.createDataFrame(rows, "frame int, region_id int, y int, left_x int, right_x int, node long")
    label = lambda n8: {r["node"]: r["rep"] for r in raster.components(df, n8).collect()}
    assert label(False) == {10: 10, 11: 11, 12: 11, 13: 13, 14: 14, 15: 15}
    assert label(True) == {10: 10, 11: 10, 12: 10, 13: 13, 14: 14, 15: 15}


def test_long_chains_reach_the_fixpoint(spark):
    n = 700
    out = graph.min_label(spark.range(n).withColumnRenamed("id", "node"), spark.range(n - 1).selectExpr("id as src", "id + 1 as dst"))
    assert {r["rep"] for r in out.collect()} == {0}
