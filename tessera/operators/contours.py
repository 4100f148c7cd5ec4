"""Contours of id images: boundary loops, shared segments, polygons, and filling them.

A boundary runs along pixel edges between grid corners. Loops keep their region on the
left, so an outer loop and its holes turn in opposite directions; corners where more than
two regions meet, or that lie on the frame, cut loops into segments that neighbours share.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Point = tuple[int, int]


def loops(mask: np.ndarray) -> list[list[Point]]:
    """Closed corner loops (x, y) around the true pixels, region on the left-hand side."""
    h, w = mask.shape
    at = lambda y, x: 0 <= y < h and 0 <= x < w and bool(mask[y, x])
    out: dict[Point, list[Point]] = {}
    for y, x in zip(*np.nonzero(mask)):
        y, x = int(y), int(x)
        for inside, a, b in ((at(y - 1, x), (x + 1, y), (x, y)), (at(y, x - 1), (x, y), (x, y + 1)), (at(y + 1, x), (x, y + 1), (x + 1, y + 1)), (at(y, x + 1), (x + 1, y + 1), (x + 1, y))):
            if not inside:
                out.setdefault(a, []).append(b)
    found = []
    while out:
        start = min(out)
        path, now, heading = [start], start, None
        while True:
            ways = out[now]
            if heading is None or len(ways) == 1:
                nxt = ways[0]
            else:  # at a touching corner stay with the same pixel: turn left first
                left = (heading[1], -heading[0])
                nxt = next((q for q in ways if (q[0] - now[0], q[1] - now[1]) == left), ways[0])
            ways.remove(nxt)
            if not ways:
                del out[now]
            heading, now = (nxt[0] - now[0], nxt[1] - now[1]), nxt
            if now == start:
                break
            path.append(now)
        found.append(path)
    return found


def signed_area(loop: list[Point]) -> float:
    """Positive for outer loops, negative for holes."""
    return -sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(loop, [*loop[1:], loop[0]])) / 2.0


def vertices(ids: np.ndarray) -> set[Point]:
    """Corners where at least three ids meet (outside counts as one)."""
    p = np.pad(ids, 1, constant_values=-1)
    quad = np.stack([p[:-1, :-1], p[:-1, 1:], p[1:, 1:], p[1:, :-1]])
    changes = (quad != np.roll(quad, 1, axis=0)).sum(axis=0)
    return {(int(x), int(y)) for y, x in zip(*np.nonzero(changes > 2))}


def segments(loop: list[Point], cuts: set[Point]) -> list[list[Point]]:
    """The loop cut at its vertices; a loop without any is one closed segment."""
    marks = [i for i, p in enumerate(loop) if p in cuts]
    if not marks:
        k = loop.index(min(loop))
        return [[*loop[k:], *loop[:k], loop[k]]]
    ring = loop + loop
    return [ring[a : b + 1] for a, b in zip(marks, [*marks[1:], marks[0] + len(loop)])]


def simplify(path: list[Point], error: float) -> list[Point]:
    """Douglas-Peucker: ends stay, and the farthest point of a stretch while it is farther
    than ``error`` from the chord."""
    keep, work = {0, len(path) - 1}, [(0, len(path) - 1)]
    pts = np.array(path, float)
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q, mid = pts[a], pts[b], pts[a + 1 : b]
        chord = q - p
        n = float(np.hypot(*chord))
        d = np.hypot(*(mid - p).T) if n == 0 else np.abs(chord[0] * (mid[:, 1] - p[1]) - chord[1] * (mid[:, 0] - p[0])) / n
        k = int(d.argmax())
        if d[k] > error:
            keep.add(a + 1 + k)
            work += [(a, a + 1 + k), (a + 1 + k, b)]
    return [path[i] for i in sorted(keep)]


def vectorise(ids: np.ndarray, error: float = 1.0, min_length: int = 4, min_hole: int = 10) -> list[tuple[int, bool, list[Point]]]:
    """(region, hole, polygon) of an id image. Each shared segment is simplified once and
    used by both neighbours; short simple holes and degenerate polygons are left out."""
    cuts, memo, out = vertices(ids), {}, []
    for region in np.unique(ids).tolist():
        for loop in loops(ids == region):
            hole = signed_area(loop) < 0
            if hole and len(loop) < min_hole and not any(p in cuts for p in loop):
                continue
            polygon: list[Point] = []
            for seg in segments(loop, cuts):
                forward = (seg[0], seg[1]) <= (seg[-1], seg[-2])
                key = tuple(seg if forward else seg[::-1])
                if key not in memo:
                    memo[key] = list(key) if len(key) <= min_length else simplify(list(key), error)
                got = memo[key] if forward else memo[key][::-1]
                polygon += got[:-1]
            if len(polygon) >= 3:
                out.append((region, hole, polygon))
    return out


def fill(polygons: list[list[Point]], width: int, height: int) -> list[tuple[int, int, int]]:
    """Even-odd scanline fill: (y, left, right) runs; right and lower borders are outside."""
    edges = []
    for poly in polygons:
        for (x0, y0), (x1, y1) in zip(poly, [*poly[1:], poly[0]]):
            if y0 != y1:
                edges.append((y0, y1, x0, x1) if y0 < y1 else (y1, y0, x1, x0))
    out = []
    for y in range(height):
        mid = y + 0.5
        xs = sorted(x0 + (x1 - x0) * (mid - y0) / (y1 - y0) for y0, y1, x0, x1 in edges if y0 <= mid < y1)
        for a, b in zip(xs[::2], xs[1::2]):
            left, right = max(0, int(np.ceil(a - 0.5))), min(width, int(np.ceil(b - 0.5))) - 1
            if left <= right:
                out.append((y, left, right))
    return out


def polygons_of(labels: DataFrame, width: int, height: int, error: float = 1.0) -> DataFrame:
    """(frame, region_id, polygon, hole, coord) for label rows, one kernel call a frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.full((height, width), -1, np.int64)
        ids[pdf["y"], pdf["x"]] = pdf["region_id"]
        rows = [(int(pdf["frame"].iloc[0]), r, k, hole, [float(v) for p in poly for v in p]) for k, (r, hole, poly) in enumerate(vectorise(ids, error)) if r >= 0]
        return pd.DataFrame(rows, columns=["frame", "region_id", "polygon", "hole", "coord"])

    return labels.groupBy("frame").applyInPandas(run, "frame int, region_id int, polygon int, hole boolean, coord array<float>")


def raster_of(polygons: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, region_id, y, left_x, right_x) from polygon rows."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        polys = [list(zip(c[::2], c[1::2])) for c in pdf["coord"]]
        return pd.DataFrame([(key[0], key[1], *r) for r in fill(polys, width, height)], columns=["frame", "region_id", "y", "left_x", "right_x"])

    return polygons.groupBy("frame", "region_id").applyInPandas(run, "frame int, region_id int, y int, left_x int, right_x int")
