"""Near copies by similarity: documents whose sets of word shingles have Jaccard 0.8 or more.

Words are maximal runs without ASCII white space after A-Z is lower-cased; a document is
the set of XXH64 values (seed 42) of its shingles of ``width`` words, or of all its words
where there are fewer. Equal word sequences are one class, searched once.

Candidates come by SimHash. The fingerprint has ``words`` words of 128 bits; a bit is set
if more than half of the document's shingles set it, so at Jaccard 0.8 two fingerprints
differ in 15 % of the bits (19 % where only four or five shingles vote) and unrelated ones
in half. Each word has a table of its distances to ``pivots`` reference words and puts the
document in the cells of the ``nearest`` ones. Two documents that share a cell are close if
``radius`` or fewer bits of the next word differ and their set sizes allow 0.8. Cells of
more than ``cell_prints`` members are compared in tiles. With 18 words, 4096 pivots and 4
nearest a pair of similarity 0.8 is missed with probability about 1e-5 (simulated).

What is close in a cell, directly or through others, is a bucket; one with the same members
in several cells counts once. Within a bucket all pairs are held against each other by their whole
fingerprints; those beyond ``limits`` (five standard deviations above the mean at 0.8, so
one at 0.8 is lost with probability 3e-7) are no candidates. Every link is verified: the
sets are intersected in full. First that goes for the nearest pairs that span the candidates
of a bucket, then, where they leave it in several components, for each component's nearest
pairs to others, more of them each round, until none is left. So no candidate between two
components stays unverified. Copies that are linked cost rows in proportion to their number;
pairs within the limits that are below 0.8 and lie between components cost a row each.

Null text counts as empty text. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, durable
from tessera.llm.simhash import reference_fingerprints

SLICE = 255
HELD = 65_536
#: Ids that may be sent to every task (8 bytes each).
SENT = 1 << 20


def shingles(text: bytes | None, width: int = 5) -> tuple[int, np.ndarray]:
    """(class, sorted distinct shingle hashes) of a UTF-8 text."""
    words = (text or b"").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    name = int(np.uint64(xxhash.xxh3_64_intdigest(joined)).view(np.int64))
    if len(words) <= width:
        return name, np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    return name, np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash fingerprint of a set of hashes: ``words`` rows of two unsigned longs."""
    steps = np.arange(1, 2 * words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(128 * words, np.int64)
    for k in range(0, len(hashes), SLICE):
        x = mixed(hashes[k : k + SLICE, None] + steps)
        votes += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8").reshape(words, 2)


def pivot_cells(found: np.ndarray, refs: np.ndarray, nearest: int) -> np.ndarray:
    """Cells of a fingerprint: for each word those of its nearest pivots, ties to the first."""
    pivots = refs.shape[1]
    table = np.bitwise_count(found[:, :1] ^ refs[0]) + np.bitwise_count(found[:, 1:] ^ refs[1])
    ranked = table.astype(np.uint32)
    ranked *= np.uint32(pivots)
    ranked += np.arange(pivots, dtype=np.uint32)
    nearest = min(nearest, pivots)
    best = np.partition(ranked, nearest - 1, axis=1)[:, :nearest] % np.uint32(pivots)
    return (np.arange(len(found))[:, None] * pivots + best).ravel().astype(np.int32)


def _signed(width: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, found = [], [], [np.empty(0, np.uint64)]
            for text in batch.column(1).to_pylist():
                name, hashes = shingles(text, width)
                names.append(name), sizes.append(len(hashes)), found.append(prints(hashes, words).ravel())
            flat = pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * 2 * words, pa.int32()), flat)],
                names=["id", "cid", "size", "print"])

    return run


def _celled(words: int, pivots: int, nearest: int):
    """mapInArrow over (cid, node, size, print): the same with the fingerprint's cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = reference_fingerprints(2 * pivots).reshape(2, pivots)
        for batch in batches:
            rows = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, words, 2)
            cells = pa.array([pivot_cells(x, refs, nearest) for x in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["cid", "node", "size", "print", "cells"])

    return run


def close_groups(cell: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by cell and size, the index of a row that stands for each row's
    group: what is connected by pairs of a cell within radius and of sizes that allow 0.8."""
    n = len(cell)
    top, left, step = np.arange(n), np.arange(n), 0
    cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    while len(left):
        step += 1
        left = left[left + step < n]
        right = left + step
        ok = (cell[left] == cell[right]) & (4 * size[right] <= 5 * size[left])
        left, right = left[ok], right[ok]
        near = np.bitwise_count(one[left] ^ one[right]) + np.bitwise_count(two[left] ^ two[right]) <= radius
        a, b = left[near], right[near]
        new = top[a] != top[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            if top[x] != top[y]:
                k = np.searchsorted(cuts, x, "right")
                part = top[cuts[k - 1] : cuts[k]]
                part[part == top[y]] = top[x]
    return top


def _close(radius: int):
    """mapInArrow over rows (cell, size, one, two, cid) sorted by cell and size: (cid, key) of
    the members of groups of two or more. The key is a hash of the members, so a group is
    the same bucket from whatever cell; were two to share one, they would be held together."""
    def solve(part: list[np.ndarray]) -> pa.RecordBatch:
        cell, size, one, two, cid = part
        top = close_groups(cell, size, one.view(np.uint64), two.view(np.uint64), radius)
        shared = np.bincount(top, minlength=len(top))[top] > 1
        key = np.zeros(len(top), np.uint64)
        np.add.at(key, top, mixed(cid.view(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (cid, key[top].view(np.int64))], names=["cid", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
            rows += batch.num_rows
            if rows < HELD:
                continue
            part = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            if last:
                yield solve([x[:last] for x in part])
            held, rows = [[x[last:] for x in part]], 0
        if held:
            yield solve([np.concatenate(x) for x in zip(*held)])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                found = [shingles(t, width) for t in batch.column(0).slice(k, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in found], pa.int64()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["cid", "shingles"])

    return run


def bucket_links(comp: list[int], sets: list[np.ndarray], side: list[int]) -> list[tuple[int, int]]:
    """Index pairs of similarity 0.8 or more that unite components of a bucket; rows of
    two sides are compared across the sides only."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    names, at = np.unique(np.array(comp), return_inverse=True)
    at, side = at.copy(), np.array(side)
    mixed, out = side.min() != side.max(), []
    for i in range(len(sets)):
        near = (side > side[i]) if mixed else (np.arange(len(sets)) > i)
        near &= (at != at[i]) & (10 * np.minimum(sizes, sizes[i]) >= 8 * np.maximum(sizes, sizes[i]))
        if not near.any():
            continue
        held = np.zeros(len(values), bool)
        held[place[starts[i] : starts[i] + sizes[i]]] = True
        both = np.add.reduceat(held[place].astype(np.int64), starts)
        for j in np.flatnonzero(near & (9 * both >= 4 * (sizes + sizes[i]))).tolist():
            if at[j] != at[i]:
                out.append((i, j))
                at[at == at[j]] = at[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows (cell, side, comp, cid, shingles) sorted by cell."""
    cell, held = None, []

    def close():
        if len(held) < 2:
            return None
        found = bucket_links([h[1] for h in held], [h[3] for h in held], [h[0] for h in held])
        ends = [pa.array([held[p[k]][2] for p in found], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    for batch in batches:
        for at, side, comp, cid, row in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
            if at != cell:
                done = close()
                if done is not None:
                    yield done
                cell, held = at, []
            held.append((side, comp, cid, row.values.to_numpy()))
    done = close()
    if done is not None:
        yield done


def limits(size: np.ndarray, words: int) -> np.ndarray:
    """Most bits of ``words`` words in which two sets of similarity 0.8 differ, the smaller
    one of this size."""
    share = np.where(size < 8, 0.19, np.where(size < 32, 0.161, 0.153))
    return 128 * words * share + 5 * np.sqrt(128 * words * share * (1 - share))


def _reach(i: int, size: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Differing bits of row i and every row; infinite where the pair is no candidate."""
    small, large = np.minimum(size, size[i]), np.maximum(size, size[i])
    bits = np.bitwise_count(found ^ found[i]).sum(axis=1, dtype=np.int64).astype(float)
    bits[(4 * large > 5 * small) | (bits > limits(small, found.shape[1] // 2))] = np.inf
    return bits


def spanning_pairs(size: np.ndarray, found: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs, the nearest ones, that span what the candidate pairs of a bucket connect."""
    best, via, left = np.full(len(size), np.inf), np.full(len(size), -1), np.ones(len(size), bool)
    out = []
    for _ in range(len(size)):
        i = int(np.argmin(np.where(left, best, np.inf)))
        if left[i] and np.isfinite(best[i]):
            out.append((int(via[i]), i))
        else:
            i = int(np.argmax(left))
        left[i] = False
        bits = _reach(i, size, found)
        nearer = left & (bits < best)
        best[nearer], via[nearer] = bits[nearer], i
    return out


def crossing_pairs(size: np.ndarray, found: np.ndarray, comp: np.ndarray, most: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, bool]:
    """Candidate pairs between components: the ``most`` nearest ones of each component, and
    whether there are more."""
    pairs, more = np.empty((3, 0)), False

    def nearest(pairs: np.ndarray) -> np.ndarray:
        pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
        n = pairs.shape[1]
        ends = np.concatenate([comp[pairs[1].astype(int)], comp[pairs[2].astype(int)]])
        order = np.lexsort((np.tile(np.arange(n), 2), ends))
        starts = np.flatnonzero(np.concatenate([[True], np.diff(ends[order]) != 0]))
        rank = np.empty(2 * n, np.int64)
        rank[order] = np.arange(2 * n) - np.repeat(starts, np.diff(np.concatenate([starts, [2 * n]])))
        return pairs[:, (rank[:n] < most) | (rank[n:] < most)]

    parts, rows = [pairs], 0
    for i in range(len(size)):
        bits = _reach(i, size, found)
        j = np.flatnonzero(np.isfinite(bits) & (comp != comp[i]))
        j = j[j > i]
        parts.append(np.stack([bits[j], np.full(len(j), float(i)), j.astype(float)]))
        rows += len(j)
        if rows >= held or i == len(size) - 1:
            pairs = np.concatenate(parts, axis=1)
            if pairs.shape[1]:
                kept = nearest(pairs)
                more, pairs = more or kept.shape[1] < pairs.shape[1], kept
            parts, rows = [pairs], 0
    return pairs[1].astype(int), pairs[2].astype(int), more


def _bucketwise(solve, names: list[str]):
    """mapInArrow over rows (key, cid, size, comp, print) sorted by key: ``solve`` of each
    bucket's (key, cid, size, comp, prints) gives columns of longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(part: list[np.ndarray]) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1], [True]]))
            found = [solve(*(x[a:b] for x in part)) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=names)

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            part.append(batch.column(4).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))
            held.append(part)
            if held[0][0][0] == part[0][-1]:
                continue
            part = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(part[0], part[0][-1]))
            yield solved([x[:last] for x in part])
            held = [[x[last:] for x in part]]
        if held:
            yield solved([np.concatenate(x) for x in zip(*held)])

    return run


def _spans(key, cid, size, comp, found):
    at = np.array(spanning_pairs(size, found), np.int64).reshape(-1, 2)
    return np.full(len(at), key[0]), cid[at].min(axis=1), cid[at].max(axis=1)


def _crossings(most: int):
    """Rows (a, b); a row whose ends are equal says that a bucket has more."""
    def solve(key, cid, size, comp, found):
        i, j, more = crossing_pairs(size, found, comp, most)
        mark = cid[:1] if more else cid[:0]
        return np.concatenate([np.minimum(cid[i], cid[j]), mark]), np.concatenate([np.maximum(cid[i], cid[j]), mark])

    return solve


def close_buckets(classes: DataFrame, words: int, pivots: int, nearest: int, radius: int, cell_prints: int) -> DataFrame:
    """(cid, key) of classes whose fingerprints are close in a cell; one key for each set of members.
    ``classes``: ``cid``, ``size``, ``print``, ``cells``."""
    large = classes.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_prints)
    # The word after the cell's own one is held against others.
    word = lambda k, half: F.get("print", (F.floor(k / nearest).cast("int") + 1) % words * 2 + half)
    placed = classes.select("cid", "size", F.explode(F.transform("cells", lambda c, k: F.struct(
        c.alias("cell"), word(k, 0).alias("one"), word(k, 1).alias("two")))).alias("at")).select("cid", "size", "at.*")
    # There are words x pivots cells at most, whatever the table.
    tiles = F.coalesce(F.ceil(F.col("n") / cell_prints), F.lit(1)).cast("int")
    tiled = placed.join(F.broadcast(large), "cell", "left").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    rows = tiled.select("cell", "size", "one", "two", "cid", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "size", "one", "two", "cid")
    return rows.repartition("cell").sortWithinPartitions("cell", "size").mapInArrow(_close(radius), "cid long, key long").distinct()


def verified(pairs: DataFrame, named: DataFrame | None, sets: DataFrame, cell_rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are of similarity 0.8 or more and unite components;
    ``cell_rows`` partners of one class at most are held against it at once."""
    tiles = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("tiles"))
    cells = pairs.join(tiles, "a").select("b", "a", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("tiles"))).alias("cell"))
    rows = cells.select("cell", F.lit(0).alias("side"), F.col("a").alias("cid")).distinct().unionByName(cells.select("cell", F.lit(1).alias("side"), F.col("b").alias("cid")))
    rows = labelled(rows, named).join(sets, "cid").select("cell", "side", "comp", "cid", "shingles")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare, "a long, b long")


def labelled(rows: DataFrame, named: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their ``cid``."""
    if named is None:
        return rows.withColumn("comp", F.col("cid"))
    return rows.join(named.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")


def similar_components(docs: DataFrame, classes: DataFrame, placed: DataFrame, width: int, cell_rows: int) -> DataFrame:
    """(node, component) of classes linked by pairs of similarity 0.8 or more that share a
    bucket. ``classes``: ``cid``, ``node``, ``size``, ``print``; ``placed``: ``cid``,
    ``key`` of the bucket."""
    members = durable(placed.join(classes.select("cid", "size", "print"), "cid"))
    solved = lambda rows, solve, names: rows.select("key", "cid", "size", "comp", "print").repartition("key").sortWithinPartitions("key").mapInArrow(
        _bucketwise(solve, names), ", ".join(f"{x} long" for x in names))
    spans = durable(solved(labelled(members, None), _spans, ["key", "a", "b"]))
    tested = durable(spans.select("a", "b").distinct())
    wanted = durable(tested.select(F.col("a").alias("cid")).unionByName(tested.select(F.col("b").alias("cid"))).distinct().join(classes.select("cid", "node"), "cid"))
    texts = semi(docs, wanted.select(F.col("node").alias("id")), "id", "left_semi").select("text")
    sets = durable(texts.mapInArrow(_sets(width), "cid long, shingles array<long>").dropDuplicates(["cid"]).join(wanted.select("cid"), "cid", "left_semi"))
    links = durable(verified(tested, None, sets, cell_rows))
    most = 8
    while True:
        named = durable(components(links, "a", "b"))
        # All candidates of a bucket lie in the trees of its spanning pairs.
        ends = labelled(labelled(spans.withColumnRenamed("a", "cid"), named).select("key", F.col("comp").alias("one"), F.col("b").alias("cid")), named)
        open_ = durable(ends.filter("one <> comp").select("key").distinct())
        if open_.isEmpty():
            return named
        found = durable(solved(labelled(members.join(open_, "key", "left_semi"), named), _crossings(most), ["a", "b"]))
        new = durable(found.filter("a <> b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            links = durable(links.unionByName(verified(new, named, sets, cell_rows)))
            tested = tested.unionByName(new)
        if found.filter("a = b").isEmpty():
            return components(links, "a", "b")
        most *= 8


def semi(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Semi or anti join of texts with ids: the texts stay where they are if the ids are few
    enough to be sent to them."""
    return docs.join(F.broadcast(ids) if ids.count() <= SENT else ids, key, how)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, words: int = 18, pivots: int = 4096,
                 nearest: int = 4, radius: int = 40, cell_prints: int = 16_384, cell_rows: int = 512) -> DataFrame:
    """Documents with one member of each component of similar ones kept: the smallest id.

    Of rows that repeat the kept id one stays. Rows with a null id are kept as they are.
    """
    plain = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    signed = durable(plain.mapInArrow(_signed(width, words), "id long, cid long, size int, print array<long>"))
    one = signed.groupBy("cid").agg(F.min("id").alias("node"), F.first("size").alias("size"), F.first("print").alias("print"))
    classes = durable(one.mapInArrow(_celled(words, pivots, nearest), "cid long, node long, size int, print array<long>, cells array<int>"))
    placed = close_buckets(classes, words, pivots, nearest, radius, cell_prints)
    named = similar_components(plain, classes, placed, width, cell_rows)
    keep = classes.join(named.withColumnRenamed("node", "cid"), "cid", "left").groupBy(F.coalesce("component", "cid")).agg(F.min("node").alias(id_col)).select(id_col)
    gone = durable(signed.select(F.col("id").alias(id_col)).distinct().join(keep, id_col, "left_anti"))
    kept = semi(docs.filter(F.col(id_col).isNotNull()), gone, id_col, "left_anti")
    if signed.groupBy("id").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull())).select(*docs.columns)
