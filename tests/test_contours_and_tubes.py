import numpy as np

from tessera.operators import contours, tubes
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_loops_cover_every_pixel_edge():
    r = np.random.default_rng(3)
    for _ in range(60):
        mask = r.random((7, 6)) < 0.55
        found = contours.loops(mask)
        assert sum(contours.signed_area(x) for x in found) == mask.sum()
        p = np.pad(mask, 1)
        edges = sum((p != np.roll(p, 1, a)).sum() for a in (0, 1))
        assert sum(len(x) for x in found) == edges


def test_exact_polygons_fill_back():
    r = np.random.default_rng(4)
    for _ in range(40):
        ids = r.integers(0, 3, (6, 7))
        polys = contours.vectorise(ids, error=0.0, min_hole=0)
        for region in range(3):
            back = np.zeros(ids.shape, bool)
            for y, a, b in contours.fill([p for q, _, p in polys if q == region], 7, 6):
                back[y, a : b + 1] = True
            assert (back == (ids == region)).all()


def test_shared_segments_agree_after_simplifying():
    ids = np.zeros((20, 20), int)
    for y in range(20):
        ids[y, 10 + (y // 3) % 2 :] = 1
    (_, _, a), (_, _, b) = contours.vectorise(ids, error=1.0)
    inner = lambda p: {q for q in p if 0 < q[0] < 20 and 0 < q[1] < 20}
    assert inner(a) == inner(b) and len(a) < 20


def test_polygon_round_trip_on_frames(spark):
    lab = fx.labels(spark, SF).filter("frame < 6")
    back = contours.raster_of(contours.polygons_of(lab, 8, 8, error=0.0), 8, 8)
    from tessera.operators import raster

    got = sorted(raster.pixels(back).select("frame", "region_id", "y", "x").collect())
    # Small isolated holes are dropped on purpose, so a pixel may lie in two regions.
    want = sorted(lab.select("frame", "region_id", "y", "x").collect())
    assert set(want) <= set(got) and len(got) < 1.3 * len(want)


def test_components_match_pixels():
    r = np.random.default_rng(5)
    for n8 in (False, True):
        mask = r.random((8, 8)) < 0.5
        rows = []
        for y in range(8):
            x = 0
            while x < 8:
                if mask[y, x]:
                    a = x
                    while x + 1 < 8 and mask[y, x + 1]:
                        x += 1
                    rows.append((y, a, x))
                x += 1
        label = {p: p for p in zip(*map(list, np.nonzero(mask)))}
        steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (abs(a) + abs(b) == 1 or n8) and (a, b) != (0, 0)]
        for _ in range(70):
            for (y, x) in label:
                for a, b in steps:
                    if (y + a, x + b) in label:
                        label[y, x] = min(label[y, x], label[y + a, x + b])
        assert len(tubes.components(rows, n8)) == len(set(label.values()))


def test_tubes_follow_and_split(spark):
    still = lambda f: [(0, f, 0, y, 0, 4) for y in range(5)]
    far = lambda f: [(0, f, 0, y, 30, 35) for y in range(20, 26)]
    rows = [r for f in range(4) for r in still(f)] + [r for f in range(2, 4) for r in far(f)]
    df = spark.createDataFrame([(f, g, y, a, b) for g, f, _, y, a, b in rows], "frame int, region_id int, y int, left_x int, right_x int")
    got = tubes.split_regions(df, 40, 40).groupBy("tube").count().collect()
    assert {r["tube"]: r["count"] for r in got} == {0: 20, 1: 12}
    whole = fx.scan_intervals(spark, SF)
    assert tubes.split_regions(whole, 8, 8).count() >= whole.count() * 0.9
