"""Order-dependent kernels against plain transcriptions of their rules on small grids."""

import random

import numpy as np
import pytest

from tessera.operators import kernels


def plain_segment(grid, min_size):
    """grid: list of frames of rows of (c0, c1, c2). Rules step by step, no union-find."""
    nodes = [(f, y, x) for f, fr in enumerate(grid) for y, row in enumerate(fr) for x in range(len(row))]
    col = {n: np.array(grid[n[0]][n[1]][n[2]], float) for n in nodes}
    edges = []
    for i, n in enumerate(nodes):
        f, y, x = n
        for s, (dy, dx) in enumerate(((0, 1), (1, 0), (1, -1), (1, 1))):
            m = (f, y + dy, x + dx)
            if m in col:
                edges.append((2 * f, i, s, n, m))
        for s, (dy, dx) in enumerate((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
            m = (f - 1, y + dy, x + dx)
            if m in col:
                edges.append((2 * f - 1, i, s, n, m))
    w = lambda e: float(np.sqrt(((col[e[3]] - col[e[4]]) ** 2).sum() / 3.0))
    order = sorted(edges, key=lambda e: (int(min(2048, w(e) * 2048 / 1.000001)), e[0], e[1], e[2]))
    group = {n: {n} for n in nodes}
    mean, closed = {n: tuple(col[n]) for n in nodes}, {n: False for n in nodes}
    name = {n: n for n in nodes}

    def merge(a, b):
        keep, gone = (a, b) if len(group[a]) > len(group[b]) else (b, a)
        na, nb = len(group[keep]), len(group[gone])
        mean[keep] = tuple((p * na + q * nb) / (na + nb) for p, q in zip(mean[keep], mean[gone]))
        for n in group[gone]:
            name[n] = keep
        group[keep] |= group.pop(gone)

    for e in order:
        a, b = name[e[3]], name[e[4]]
        if a == b:
            continue
        if not closed[a] and not closed[b]:
            d = (sum((p - q) ** 2 for p, q in zip(mean[a], mean[b])) / 3.0) ** 0.5
            if d < 0.05 or (w(e) < 0.001 and d < 0.2):
                merge(a, b)
                continue
            closed[a] = closed[b] = True
        if min(len(group[a]), len(group[b])) < min_size:
            merge(a, b)
    return {frozenset(g) for g in group.values()}


@pytest.mark.parametrize("seed", range(6))
def test_voxel_segmentation(spark, seed):
    r = random.Random(seed)
    grid = [[[tuple(r.choice((0.1, 0.13, 0.5, 0.52)) for _ in range(3)) for _ in range(5)] for _ in range(4)] for _ in range(2)]
    rows = [(0, f, y, x, *c) for f, fr in enumerate(grid) for y, row in enumerate(fr) for x, c in enumerate(row)]
    df = spark.createDataFrame(rows, "chunk_id int, frame int, y int, x int, c0 double, c1 double, c2 double")
    got: dict = {}
    for q in kernels.segment_voxels(df, 5, 4, min_size=3).collect():
        n = q["node"]
        got.setdefault(q["rep"], set()).add((n // 20, n // 5 % 4, n % 5))
    assert {frozenset(g) for g in got.values()} == plain_segment(grid, 3)


def test_n4_repair_leaves_no_lone_diagonal():
    r = np.random.default_rng(1)
    for _ in range(50):
        done = kernels.repair_n4(r.integers(0, 3, (6, 5)))
        for y in range(5):
            for x in range(4):
                a, b, c, d = done[y, x], done[y, x + 1], done[y + 1, x], done[y + 1, x + 1]
                assert not (a == d and b != a and c != a), done


def test_cheapest_first_counts_and_ties():
    nodes = {i: (1, i / 100) for i in range(10)}
    edges = [(i, i + 1, 0.1) for i in range(9)]
    rep = kernels.cheapest_first(nodes, edges, 0.8)
    assert len(set(rep.values())) == 10 - int(10 * (1 - 0.8))
    assert len(set(kernels.cheapest_first(nodes, edges, 0.0).values())) == 1
    assert kernels.cheapest_first({1: (1, 0.0), 2: (1, 0.0)}, [(1, 2, 0.0)], 0.4) == {1: 2, 2: 2}


def forest_of(values, pins):
    return kernels.Forest(np.array([[v] * 3 for v in values], float), pins)


def test_pinned_regions():
    f = forest_of([0.1, 0.1, 0.5, 0.5], [7, 7, 9, -1])
    kernels.join_pinned(f)
    assert f.find(0) == f.find(1) and f.find(2) != f.find(0)
    counts: dict = {}
    left = kernels.merge_edges(f, [(0, 0, 0, 1, 2, 0.0), (0, 0, 1, 2, 3, 0.0)], 1, counts=counts)
    assert left == [(f.find(0), 2)] and f.find(2) == f.find(3) and f.pinned[f.find(3)] == 9 and counts == {"regular": 1}


def test_drifted_members_are_freed():
    f = forest_of([0.1, 0.1, 0.1, 0.1, 0.9], [3, 3, 3, 3, 3])
    kernels.join_pinned(f)
    assert len({f.find(i) for i in range(4)}) == 1 and f.find(4) != f.find(0)
    assert f.pinned[4] == -1 and f.pinned[f.find(0)] == 3
    g = forest_of([0.1, 0.9], [3, 3])
    kernels.join_pinned(g)
    assert g.pinned == [-1, -1]
    v = forest_of([0.1, 0.9], [3, 3])
    kernels.join_pinned(v, virtual=frozenset({1}))
    assert v.find(0) == v.find(1)


def test_thin_structures():
    ids = np.zeros((5, 5), int)
    ids[:, 2] = 1
    done = kernels.suppress_thin(ids)
    assert (done == 0).all()
    block = np.zeros((6, 6), int)
    block[2:5, 2:5] = 1
    assert (kernels.suppress_thin(block)[2:5, 2:5] == 1).sum() >= 5


def test_results_are_rasters_and_neighbours(spark):
    # Two frames of 2 x 3: region 0 is the left column over both, 1 the rest of frame 0, 7 of frame 1.
    rep = {0: 0, 3: 0, 6: 0, 9: 0, 1: 1, 2: 1, 4: 1, 5: 1, 7: 7, 8: 7, 10: 7, 11: 7}
    assign = spark.createDataFrame(list(rep.items()), "node long, rep long")
    pairs = spark.createDataFrame([(0, 1), (1, 7), (3, 4), (10, 4), (1, 2)], "src long, dst long")
    rasters, regions = kernels.results(assign, pairs, 3, 2)
    assert sorted(tuple(r) for r in rasters.collect()) == sorted([(f, r, y, a, b) for f in (0, 1) for y in (0, 1) for r, a, b in ((0, 0, 0), ((1, 7)[f], 1, 2))])
    assert {r["region_id"]: (r["size"], r["first"], r["last"], r["neighbours"]) for r in regions.collect()} == {0: (4, 0, 1, [1]), 1: (4, 0, 0, [0, 7]), 7: (4, 1, 1, [1])}
