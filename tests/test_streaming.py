import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels
from tessera.plans import fixtures as fx
from tessera.streaming import chunks, units

SF = "/root/testdata/sf0.001"


def by_hand(n_frames, size):
    """Chunk of each frame from the buffer rule, step by step."""
    shared, out, chunk, held = chunks.overlap(size), [], 0, 0
    for _ in range(n_frames):
        out.append(chunk)
        held += 1
        if held == size - shared + 1:
            held, chunk = 0, chunk + 1
    return out


@pytest.mark.parametrize("size", [8, 9, 12, 20, 31])
def test_closed_form_chunks(spark, size):
    n = 3 * size
    got = spark.range(n).select(chunks.chunk_columns(F.col("id"), size)["chunk_id"].alias("c"), "id").orderBy("id").collect()
    assert [r["c"] for r in got] == by_hand(n, size)
    with pytest.raises(ValueError):
        chunks.stride(7)


def test_stream_gives_the_batch_segmentation(spark, tmp_path):
    vox = fx.voxels(spark, SF).filter("frame < 60").withColumn("video_id", F.lit(1))
    n = chunks.stride(20)
    src = tmp_path / "in"
    for k, part in enumerate(((0, 10), (10, 33), (33, 60))):  # files of uneven size
        vox.filter(f"frame >= {part[0]} and frame < {part[1]}").withColumnRenamed("frame", "pts").withColumn("pts", F.col("pts").cast("long")).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    schema = spark.read.parquet(f"{src}/0").schema

    def segment(video, chunk, rows):
        at = rows[["frame", "y", "x"]].sort_values(["frame", "y", "x"])
        rows = rows.loc[at.index]
        pos, col = rows[["frame", "y", "x"]].to_numpy(), rows[["c0", "c1", "c2"]].to_numpy(float)
        forest = kernels.Forest(col)
        kernels.merge_edges(forest, kernels.grid_edges(pos, col), 6)
        node = pos[:, 0] * 64 + pos[:, 1] * 8 + pos[:, 2]
        low = {}
        roots = [forest.find(i) for i in range(len(pos))]
        for v, r in zip(node.tolist(), roots):
            low.setdefault(r, v)
        return pd.DataFrame({"chunk_id": chunk, "node": node, "rep": [low[r] for r in roots]})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = chunks.in_chunks(stream, segment, "chunk_id int, node long, rep long")
    q = out.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("segments").collect())
    batch = kernels.segment_voxels(fx.voxels(spark, SF).filter(f"frame < {60 // n * n}").withColumn("chunk_id", F.expr(f"cast(frame div {n} as int)")), 8, 8)
    assert got == sorted((r["chunk_id"], r["node"], r["rep"]) for r in batch.collect()) and got


def test_unit_tree(spark):
    root = units.Unit("reader")
    gray = units.Unit("gray", lambda d: d.withColumn("luminance", F.col("c0")), ("luminance",), ("c0",)).attach_to(root)
    dark = units.Unit("dark", lambda d: d.withColumn("is_dark", F.col("luminance") < 0.3), ("is_dark",), ("luminance",)).attach_to(gray)
    assert root.show() == "reader\n  gray\n    dark" and dark.root() is root and root.has(dark)
    df = spark.createDataFrame([(0, 0.2), (1, 0.9)], "frame int, c0 double")
    plans = root.run(df)
    assert [tuple(r) for r in plans["dark"].orderBy("frame").collect()] == [(0, 0.2, 0.2, True), (1, 0.9, 0.9, False)]
    assert units.stream_index("luminance", plans["dark"].columns) == 2 and units.stream_index("x", []) == -1
    with pytest.raises(ValueError):
        units.Unit("again", opens=("c0",)).open_streams(("frame", "c0"))
    dark.remove()
    assert [u.name for u in root.downstream()] == ["gray"]
    assert units.scaled_rate(20, 10, 10) == 20 and units.scaled_rate(20, 20, 10) == 10 and units.scaled_rate(20, 500, 10) == 4
    assert units.seek(df, 1, "frame").count() == 1
    assert units.slowest_and_longest([{"processedRowsPerSecond": 4.0, "numInputRows": 2}, {"processedRowsPerSecond": 1.0, "numInputRows": 9}]) == (1.0, 9)


def test_the_last_partial_chunk_comes_out(spark, tmp_path):
    rows = [(v, p, p == last) for v, last in ((1, 44), (2, 18), (3, 7)) for p in range(last + 1)]
    df = spark.createDataFrame(rows, "video_id int, pts long, ends boolean")
    df.filter("pts < 20").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    df.filter("pts >= 20").coalesce(1).write.parquet(f"{tmp_path}/in/1")

    def count(video, chunk, part):
        return pd.DataFrame({"video_id": [video], "chunk_id": [chunk], "n": [len(part)]})

    out = chunks.in_chunks(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), count, "video_id int, chunk_id int, n int", final="ends")
    q = out.writeStream.format("memory").queryName("tails").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert units.join_all([q], 120)
    want = sorted((v, c, n) for v, sizes in ((1, (19, 19, 7)), (2, (19,)), (3, (8,))) for c, n in enumerate(sizes))
    assert sorted(tuple(r) for r in spark.table("tails").collect()) == want
    batch = chunks.all_chunks(df.withColumnRenamed("pts", "frame"), count, "video_id int, chunk_id int, n int")
    assert sorted(tuple(r) for r in batch.collect()) == want


def test_region_ids_are_stable_over_chunks(spark, tmp_path):
    """Two flat halves over three chunks keep their ids; a patch that appears gets a new one."""
    rows = [(1, f, y, x, *((0.1,) * 3 if x < 4 else (0.8,) * 3), False) for f in range(50) for y in range(6) for x in range(8)]
    rows = [(*r[:4], *((0.45,) * 3), r[7]) if r[1] >= 30 and r[2] < 3 and r[3] < 3 else r for r in rows]
    rows[-1] = (*rows[-1][:7], True)
    df = spark.createDataFrame(rows, "video_id int, pts long, y int, x int, c0 double, c1 double, c2 double, ends boolean")
    df.filter("pts < 25").coalesce(1).write.parquet(f"{tmp_path}/in/0")
    df.filter("pts >= 25").coalesce(1).write.parquet(f"{tmp_path}/in/1")

    def segment(video, chunk, part, carried):
        return kernels.segment_after(part[["frame", "y", "x", "c0", "c1", "c2"]], carried)

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = chunks.in_chunks(stream, segment, "frame int, y int, x int, region_id int", final="ends", carry=True)
    q = out.writeStream.format("memory").queryName("carried").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert units.join_all([q], 120)
    got = {(r["frame"], r["y"], r["x"]): r["region_id"] for r in spark.table("carried").collect()}
    assert len(got) == 50 * 48
    left, right, patch = got[0, 5, 0], got[0, 5, 7], got[40, 0, 0]
    assert len({left, right, patch}) == 3
    for (f, y, x), region in got.items():
        assert region == (right if x >= 4 else patch if f >= 30 and y < 3 and x < 3 else left), (f, y, x)
