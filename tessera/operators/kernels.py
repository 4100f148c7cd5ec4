"""Order-dependent merging: one sequential kernel per group, groups in parallel.

Greedy merging depends on the order of edges and on descriptors that change with every
merge, so it runs as a grouped kernel keyed by chunk or chunk set; a group is one chunk
(a bounded number of frames), never a whole video.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import BUCKETS, SPATIAL, TEMPORAL, surviving_neighbours
from tessera.operators.raster import run_lengths


class Forest:
    """Union-find over regions with mean descriptors."""

    def __init__(self, means: np.ndarray, pinned: list[int] | None = None):
        n = len(means)
        self.pinned = list(pinned) if pinned is not None else [-1] * n
        self.up = list(range(n))
        self.size = [1] * n
        self.mean = [tuple(m) for m in means.tolist()]
        self.closed = [False] * n

    def find(self, x: int) -> int:
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def distance(self, a: int, b: int) -> float:
        return (sum((p - q) ** 2 for p, q in zip(self.mean[a], self.mean[b])) / 3.0) ** 0.5

    def merge(self, a: int, b: int) -> int:
        """The larger side stays, the second on a tie."""
        keep, gone = (a, b) if self.size[a] > self.size[b] else (b, a)
        n = self.size[keep] + self.size[gone]
        self.mean[keep] = tuple((p * self.size[keep] + q * self.size[gone]) / n for p, q in zip(self.mean[keep], self.mean[gone]))
        self.size[keep], self.up[gone] = n, keep
        self.pinned[keep] = max(self.pinned[keep], self.pinned[gone])
        return keep

    def loosen(self, a: int, b: int, share: float = 0.3) -> None:
        """Free the much smaller of two regions that drifted apart, else both."""
        small, large = (a, b) if self.size[a] < self.size[b] else (b, a)
        self.pinned[small] = -1
        if self.size[small] >= share * self.size[large]:
            self.pinned[large] = -1


def join_pinned(forest: Forest, split: float = 0.15, virtual: frozenset[int] = frozenset()) -> None:
    """One representative per constraint before the greedy pass. A member whose mean is too
    far from the representative is freed instead; virtual members always join."""
    heads: dict[int, int] = {}
    for i in range(len(forest.up)):
        c = forest.pinned[i]
        if c < 0 or forest.find(i) != i:
            continue
        head = heads.get(c)
        if head is None or forest.pinned[head] != c:
            heads[c] = i
        elif i not in virtual and head not in virtual and forest.distance(head, i) > split:
            forest.loosen(head, i)
        else:
            heads[c] = forest.merge(head, i)


def suppress_thin(ids: np.ndarray, rounds: int = 8) -> np.ndarray:
    """A pixel with at most two N8 neighbours of its own id takes the id that two or more of
    its N4 neighbours share (the smallest such); repeated until nothing changes."""
    out = ids.copy()
    h, w = out.shape
    for _ in range(rounds):
        changed = False
        for y in range(h):
            for x in range(w):
                block = out[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                if (block == out[y, x]).sum() - 1 > 2:
                    continue
                cross = [out[b, a] for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= b < h and 0 <= a < w]
                twice = sorted({v for v in cross if cross.count(v) >= 2 and v != out[y, x]})
                if twice:
                    out[y, x], changed = twice[0], True
        if not changed:
            break
    return out


def grid_edges(frames: np.ndarray, colours: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
    """Sorted edges of a chunk: (bucket, list, sequence, a, b, weight). ``frames``: rows
    (frame, y, x) in that order; every offset is one lookup of all voxels at once."""
    if not len(frames):
        return []
    at = frames.astype(np.int64) - frames.min(axis=0)
    deep, wide = at[:, 1].max() + 3, at[:, 2].max() + 3
    key = (at[:, 0] * deep + at[:, 1] + 1) * wide + at[:, 2] + 1
    own = np.arange(len(frames))
    parts = []
    for steps, back in ((SPATIAL, 0), (TEMPORAL, 1)):
        for seq, (dy, dx) in enumerate(steps):
            want = key + (dy - back * deep) * wide + dx
            j = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[j] == want
            parts.append(np.stack([2 * frames[hit, 0] - back, own[hit] * 16 + seq, own[hit], j[hit]], axis=1))
    arr = np.concatenate(parts)
    d = colours[arr[:, 2]] - colours[arr[:, 3]]
    weight = np.sqrt((d * d).sum(axis=1) / 3.0)
    bucket = np.minimum(BUCKETS, weight * BUCKETS / 1.000001).astype(np.int64)
    order = np.lexsort((arr[:, 1], arr[:, 0], bucket))
    return list(zip(bucket[order].tolist(), *arr[order].T.tolist(), weight[order].tolist()))


def merge_edges(forest: Forest, edges, min_size: int, threshold: float = 0.05, force: float = 0.001, split: float = 0.15,
                counts: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """Run the greedy pass; the edges that stay between regions.

    Two regions pinned to different constraints never merge; two of one constraint merge
    unless they drifted apart. ``counts`` gathers regular, small and pinned merges.
    """
    left = []
    counts = {} if counts is None else counts

    def tally(kind: str) -> None:
        counts[kind] = counts.get(kind, 0) + 1

    for _, _, _, a, b, w in edges:
        a, b = forest.find(a), forest.find(b)
        if a == b:
            continue
        if forest.pinned[a] >= 0 and forest.pinned[b] >= 0:
            if forest.pinned[a] == forest.pinned[b]:
                if forest.distance(a, b) <= split:
                    forest.merge(a, b)
                    tally("pinned")
                    continue
                forest.loosen(a, b)
            left.append((a, b))
            continue
        if not forest.closed[a] and not forest.closed[b]:
            d = forest.distance(a, b)
            if d < threshold or (w < force and d < 0.2):
                forest.merge(a, b)
                tally("regular")
                continue
            forest.closed[a] = forest.closed[b] = True
        if min(forest.size[a], forest.size[b]) < min_size:
            forest.merge(a, b)
            tally("small")
        else:
            left.append((a, b))
    return left


def results(assignment: DataFrame, edges: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """What a segmentation (node, rep) consists of: its rasters (frame, region_id, y, left_x,
    right_x), and its regions (region_id, size, first, last, neighbours) by the edges (src, dst)."""
    at = assignment.select(F.expr(f"cast(node div {width * height} as int)").alias("frame"), F.expr(f"cast(node % {width * height} div {width} as int)").alias("y"),
                           F.expr(f"cast(node % {width} as int)").alias("x"), F.col("rep").alias("region_id"))
    near = surviving_neighbours(edges.select("src", "dst"), assignment.select("node", "rep")).withColumnRenamed("rep", "region_id")
    sizes = at.groupBy("region_id").agg(F.count(F.lit(1)).alias("size"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    none = F.array().cast("array<long>")
    return run_lengths(at), sizes.join(near, "region_id", "left").withColumn("neighbours", F.coalesce("neighbours", none))


def segment_voxels(voxels: DataFrame, width: int, height: int, min_size: int = 6) -> DataFrame:
    """(chunk_id, node, rep): rep is the smallest node of the region. A ``constr`` column,
    -1 where free, pins voxels to regions of the chunk before."""
    pinned = "constr" in voxels.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "y", "x"])
        at = pdf[["frame", "y", "x"]].to_numpy()
        colours = pdf[["c0", "c1", "c2"]].to_numpy(float)
        forest = Forest(colours, pdf["constr"].tolist() if pinned else None)
        if pinned:
            join_pinned(forest)
        merge_edges(forest, grid_edges(at, colours), min_size)
        node = at[:, 0].astype(np.int64) * (width * height) + at[:, 1] * width + at[:, 2]
        low: dict[int, int] = {}
        roots = [forest.find(i) for i in range(len(at))]
        for i, r in enumerate(roots):
            low.setdefault(r, int(node[i]))
        return pd.DataFrame({"chunk_id": pdf["chunk_id"].to_numpy(), "node": node, "rep": [low[r] for r in roots]})

    return voxels.groupBy("chunk_id").applyInPandas(run, "chunk_id int, node long, rep long")


def segment_after(rows: pd.DataFrame, carried: tuple[pd.DataFrame, int] | None, min_size: int = 6) -> tuple[pd.DataFrame, tuple[pd.DataFrame, int]]:
    """Segment a chunk so that regions keep their ids over chunks.

    ``rows``: frame, y, x, c0, c1, c2. ``carried``: the last frame of the chunk before with the
    ``region_id`` of each voxel, and the first free id. That frame joins the graph pinned to
    its ids: members of one id are one region before the pass, regions of two ids never merge,
    and what drifted apart is freed. A region that holds carried voxels keeps their id, others
    get the next free ones in order of their first voxel. Returns (frame, y, x, region_id) of
    the chunk's own frames and what the next chunk is to get.
    """
    before, free = (None, 0) if carried is None else carried
    own = rows.assign(region_id=-1)
    both = own if before is None else pd.concat([before, own])
    both = both.sort_values(["frame", "y", "x"], kind="stable").reset_index(drop=True)
    at, colours = both[["frame", "y", "x"]].to_numpy(), both[["c0", "c1", "c2"]].to_numpy(float)
    pins = both["region_id"].tolist()
    forest = Forest(colours, pins)
    join_pinned(forest)
    merge_edges(forest, grid_edges(at, colours), min_size)
    ids: dict[int, int] = {}
    roots = [forest.find(i) for i in range(len(at))]
    used: set[int] = set()
    for i, r in enumerate(roots):
        if r not in ids and pins[i] >= 0 and forest.pinned[r] == pins[i] and pins[i] not in used:
            ids[r] = pins[i]
            used.add(pins[i])
    for r in roots:
        if r not in ids:
            ids[r], free = free, free + 1
    both["region_id"] = [ids[r] for r in roots]
    mine = both if before is None else both[both["frame"] > before["frame"].max()]
    last = mine[mine["frame"] == mine["frame"].max()]
    return mine[["frame", "y", "x", "region_id"]].reset_index(drop=True), (last.reset_index(drop=True), free)


def repair_n4(ids: np.ndarray) -> np.ndarray:
    """Row by row: where only a diagonal below shares the id, the pixel below takes it."""
    out = ids.copy()
    h, w = out.shape
    for y in range(h - 1):
        for x in range(w):
            v = out[y, x]
            if out[y + 1, x] == v:
                continue
            for dx in (-1, 1):
                nx = x + dx
                if 0 <= nx < w and out[y + 1, nx] == v and out[y, nx] != v:
                    out[y + 1, x] = v
                    break
    return out


def enforce_n4(labels: DataFrame, width: int, height: int) -> DataFrame:
    """Labels of each frame after the N4 repair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        grid = np.full((height, width), -1, np.int64)
        grid[pdf["y"], pdf["x"]] = pdf["region_id"]
        done = repair_n4(grid)
        return pd.DataFrame({"frame": pdf["frame"].to_numpy(), "y": pdf["y"].to_numpy(), "x": pdf["x"].to_numpy(), "region_id": done[pdf["y"], pdf["x"]]})

    return labels.groupBy("frame").applyInPandas(run, "frame int, y int, x int, region_id int")


def cheapest_first(nodes: dict[int, tuple[int, float]], edges: list[tuple[int, int, float]], cutoff: float, scale: float = 10.0) -> dict[int, int]:
    """Greedy merging of the front edge of the lowest bucket until a share ``cutoff`` of the
    regions is left. Distances to all neighbours of a merged region are computed anew and
    go to the back of their buckets. Returns node -> representative."""
    up = {n: n for n in nodes}
    size = {n: s for n, (s, _) in nodes.items()}
    mean = {n: m for n, (_, m) in nodes.items()}
    merged = dict.fromkeys(nodes, 1)

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    slot = lambda w: min(BUCKETS, int(w * BUCKETS / 1.01))
    dist = lambda a, b: min(1.0, scale * abs(mean[a] - mean[b]))
    buckets = [deque() for _ in range(BUCKETS + 1)]
    near: dict[int, dict[int, int]] = {n: {} for n in nodes}
    serial = 0

    def put(a: int, b: int, w: float) -> int:
        nonlocal serial
        serial += 1
        near[a][b] = near[b][a] = serial
        buckets[slot(w)].append((a, b, serial))
        return slot(w)

    for a, b, w in edges:
        put(a, b, w)
    todo, at = min(int(len(nodes) * (1 - cutoff)), len(nodes) - 1), 0
    while todo > 0 and at <= BUCKETS:
        if not buckets[at]:
            at += 1
            continue
        a, b, mark = buckets[at].popleft()
        if near.get(a, {}).get(b) != mark:
            continue  # superseded
        keep, gone = (a, b) if merged[a] > merged[b] else (b, a)
        around = (set(near[keep]) | set(near[gone])) - {keep, gone}
        for n in around:
            near[n].pop(keep, None), near[n].pop(gone, None)
        n = size[keep] + size[gone]
        mean[keep] = (mean[keep] * size[keep] + mean[gone] * size[gone]) / n
        size[keep], up[gone] = n, keep
        merged[keep] += merged[gone]
        near[keep], near[gone] = {}, {}
        for n in sorted(around):
            at = min(at, put(keep, n, dist(keep, n)))
        todo -= 1
    return {n: find(n) for n in nodes}


def agglomerate(edges: DataFrame, nodes: DataFrame, cutoff: float = 0.8, levels: int = 4) -> DataFrame:
    """(set_id, level, node, rep) for each level of a chunk set, from edges (set_id, src,
    dst, weight) and nodes (set_id, id, size, mean)."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {int(i): (int(s), float(m)) for i, s, m in zip(right["id"], right["size"], right["mean"])}
        pairs = sorted((int(a), int(b), float(w)) for a, b, w in zip(left["src"], left["dst"], left["weight"]))
        whole = {n: n for n in at}
        out = []
        for level in range(levels):
            rep = cheapest_first(at, pairs, cutoff)
            if len(set(rep.values())) == len(at):
                break
            whole = {n: rep[r] for n, r in whole.items()}
            out += [(key[0], level, n, r) for n, r in sorted(whole.items())]
            total: dict[int, tuple[int, float]] = {}
            for n, (s, m) in at.items():
                ps, pm = total.get(rep[n], (0, 0.0))
                total[rep[n]] = (ps + s, (pm * ps + m * s) / (ps + s))
            at = total
            pairs = sorted({(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b, _ in pairs if rep[a] != rep[b]})
            pairs = [(a, b, min(1.0, 10.0 * abs(at[a][1] - at[b][1]))) for a, b in pairs]
        return pd.DataFrame(out, columns=["set_id", "level", "node", "rep"])

    return edges.groupBy("set_id").cogroup(nodes.groupBy("set_id")).applyInPandas(run, "set_id int, level int, node long, rep long")
