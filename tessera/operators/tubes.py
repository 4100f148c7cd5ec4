"""Connected components of a region over time: slices, tubes, splits.

A slice is one N4 component of a region in one frame; a tube a chain of slices. All slices
of a region in one chunk are a bounded group, so a region is one kernel call.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

Interval = tuple[int, int, int]


def components(rows: list[Interval], n8: bool = False) -> list[list[Interval]]:
    """Connected sets of (y, left, right) intervals, each sorted, in order of first row."""
    rows = sorted(rows)
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    gap, by_row = int(n8), {}
    for i, (y, a, b) in enumerate(rows):
        for j in by_row.get(y - 1, []) + (by_row.get(y, []) if n8 else []):
            if a <= rows[j][2] + gap and rows[j][1] <= b + gap:
                up[max(find(i), find(j))] = min(find(i), find(j))
        by_row.setdefault(y, []).append(i)
    groups: dict[int, list[Interval]] = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [groups[k] for k in sorted(groups)]


class Slice:
    """One component in one frame with its size and centre."""

    def __init__(self, frame: int, rows: list[Interval]):
        self.frame, self.rows = frame, rows
        self.size = sum(b - a + 1 for _, a, b in rows)
        self.x = sum((a + b) * (b - a + 1) / 2 for _, a, b in rows) / self.size
        self.y = sum(y * (b - a + 1) for y, a, b in rows) / self.size


Tube = list[Slice]


def gap_between(p: Slice, q: Slice) -> float:
    return math.hypot(p.x - q.x, p.y - q.y)


def mean_distance(a: Tube, b: Tube) -> float:
    """Mean centre distance over shared frames; infinite without any."""
    at = {s.frame: s for s in b}
    d = [gap_between(s, at[s.frame]) for s in a if s.frame in at]
    return sum(d) / len(d) if d else math.inf


def closest(tube: Tube, others: list[Tube]) -> int:
    """Index of the nearest other tube that shares a frame, first of equals; -1 if none."""
    d = [(mean_distance(tube, o), k) for k, o in enumerate(others) if o is not tube]
    best = min(d, default=(math.inf, -1))
    return best[1] if best[0] < math.inf else -1


def joined(a: Tube, b: Tube) -> Tube:
    """Slices of two tubes by frame; slices of one frame become one."""
    by: dict[int, list[Interval]] = {}
    for s in (*a, *b):
        by.setdefault(s.frame, []).extend(s.rows)
    return [Slice(f, sorted(r)) for f, r in sorted(by.items())]


def track(frames: list[tuple[int, list[Interval]]], diagonal: float, ratio: float = 0.75, move: float = 0.04) -> list[Tube]:
    """Chain the components of successive frames: a slice continues the nearest open tube
    of similar size that hardly moved and is still free, else it begins a new one."""
    done: list[Tube] = []
    open_tubes: list[Tube] = []
    for frame, rows in sorted(frames):
        following: list[Tube] = []
        free = set(range(len(open_tubes)))
        for part in components(rows):
            s = Slice(frame, part)
            ranked = sorted((gap_between(s, open_tubes[k][-1]), k) for k in range(len(open_tubes)) if open_tubes[k][-1].frame == frame - 1)
            if ranked:
                d, k = ranked[0]
                last = open_tubes[k][-1].size
                if k in free and min(last, s.size) / (max(last, s.size) + 1e-6) > ratio and d / diagonal < move:
                    free.discard(k)
                    following.append([*open_tubes[k], s])
                    continue
            following.append([s])
        done += [open_tubes[k] for k in sorted(free)]
        open_tubes = following
    return done + open_tubes


def settle(tubes: list[Tube], diagonal: float, small: float = 20.0) -> list[Tube]:
    """Fold small tubes into the closest one, then join tubes that follow each other."""
    tubes, k = list(tubes), 0
    while k < len(tubes):
        t = tubes[k]
        if sum(s.size for s in t) / len(t) < small and (j := closest(t, tubes)) >= 0:
            tubes[j] = joined(tubes[j], t)
            del tubes[k]
        else:
            k += 1
    k = 0
    while k < len(tubes):
        for j, o in enumerate(tubes):
            if j != k and (o[0].frame == tubes[k][-1].frame + 1 and gap_between(o[0], tubes[k][-1]) / diagonal < 0.04
                           or tubes[k][0].frame == o[-1].frame + 1 and gap_between(o[-1], tubes[k][0]) / diagonal < 0.04):
                tubes[j] = joined(tubes[k], o)
                del tubes[k]
                break
        else:
            k += 1
    return tubes


def split_regions(intervals: DataFrame, width: int, height: int) -> DataFrame:
    """Intervals (frame, region_id, y, left_x, right_x) with ``tube`` per region: 0 for the
    largest, which keeps the region's id, others in order. With a ``chunk_id`` column regions
    are split within their chunk, so a group never spans a whole video."""
    keys = ["chunk_id", "region_id"] if "chunk_id" in intervals.columns else ["region_id"]
    diagonal = math.hypot(width, height)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        region = int(pdf["region_id"].iloc[0])
        frames = [(int(f), list(zip(g["y"].tolist(), g["left_x"].tolist(), g["right_x"].tolist()))) for f, g in pdf.groupby("frame")]
        tubes = settle(track(frames, diagonal), diagonal)
        order = sorted(range(len(tubes)), key=lambda k: (-sum(s.size for s in tubes[k]), k))
        rows = [(s.frame, region, n, y, a, b) for n, k in enumerate(order) for s in tubes[k] for y, a, b in s.rows]
        return pd.DataFrame(rows, columns=["frame", "region_id", "tube", "y", "left_x", "right_x"])

    return intervals.groupBy(*keys).applyInPandas(run, "frame int, region_id int, tube int, y int, left_x int, right_x int")
