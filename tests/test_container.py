import struct

import numpy as np
import pytest

from tessera.operators import raster
from tessera.plans import fixtures as fx
from tessera.sources import container as ct

MESSAGE = {
    "region": [{"id": 3, "raster": {"scan_inter": [{"y": 0, "left_x": 1, "right_x": 4}, {"y": 2, "left_x": 0, "right_x": 300}]}, "shape_moments": {"size": 5.0, "mean_x": 1.5}}],
    "hierarchy": [{"region": [{"id": 3, "size": 5, "neighbor_id": [1, 9], "parent_id": -1, "child_id": [], "start_frame": 0, "end_frame": 7}]}],
    "frame_width": 640, "frame_height": 360, "chunk_id": -1, "vector_mesh": {"coord": [1.0, 2.5]},
}


def test_message_round_trip_and_unknown_fields():
    back = ct.decode(ct.encode(MESSAGE) + bytes([(99 << 3 | 2) & 127 | 128, 6, 2, 1, 2]))
    assert back["region"][0]["raster"] == MESSAGE["region"][0]["raster"] and back["chunk_id"] == -1
    assert back["hierarchy"][0]["region"][0] == MESSAGE["hierarchy"][0]["region"][0] and back["vector_mesh"]["coord"] == [1.0, 2.5]


@pytest.mark.parametrize("chunk", [None, 1, 3, 100])
def test_container_index(chunk):
    frames = [(40 * i, bytes([i]) * i) for i in range(8)]
    data = ct.pack(frames, chunk)
    found = ct.index(data)
    assert [(p, ct.frame_bytes(data, o)) for _, _, p, o in found] == frames
    assert [c for _, c, _, _ in found] == [i // (chunk or 8) for i in range(8)]
    with pytest.raises(ValueError):
        ct.index(data[:-8])
    assert ct.index(ct.pack([])) == []


def test_strip_layout():
    small = ct.strip(ct.decode(ct.encode(MESSAGE)), moments=True)
    assert struct.unpack_from("<5i", small) == (640, 360, 1, 3, 2)
    assert struct.unpack_from("<6h", small, 20) == (0, 1, 4, 2, 0, 300)
    assert struct.unpack("<8i", small[32 + 24 :]) == (1, 1, 3, 5, -1, 0, 0, 7)


def test_write_read_round_trip(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    inter = fx.scan_intervals(spark, sf).filter("frame < 12")
    from pyspark.sql import functions as F

    spark.dataSource.register(ct.ContainerSink)
    out = str(tmp_path / "video")
    ct.messages(inter, 8, 8).select("frame", (F.col("frame") * 40_000).cast("long").alias("pts"), "message").repartition(1).write.format("tessera_container").mode("append").option("path", out).option("chunk", 5).save()
    assert ct.exists(spark, out) and not ct.exists(spark, out + "x")
    frames = ct.read_frames(spark, out)
    assert sorted((r["frame"], r["chunk_id"], r["pts"]) for r in frames.collect()) == [(f, f // 5, 40_000 * f) for f in range(12)]
    key = ["frame", "region_id", "y", "left_x", "right_x"]
    assert sorted(ct.intervals(frames).select(*key).collect()) == sorted(inter.select(*key).collect())
    assert ct.read_frames(spark, out, (3, 4)).count() == 2
    assert raster.area(ct.intervals(frames), ["frame"]).filter("area <> 64").count() == 0
    assert ct.hierarchy(frames).count() == 0


def test_flow_and_project_files(spark, tmp_path):
    image = np.arange(24, dtype=np.float32).reshape(3, 4, 2)
    (tmp_path / "a.flow").write_bytes(ct.pack_flow(4, 3, [image, image + 1]))
    rows = ct.read_flow(spark, str(tmp_path / "a.flow")).collect()
    assert len(rows) == 24 and {r["frame"] for r in rows} == {1, 2}
    assert next((r["fx"], r["fy"]) for r in rows if (r["frame"], r["y"], r["x"]) == (2, 1, 2)) == (13.0, 14.0)
    (tmp_path / "p.json").write_text('{"labels":[{"name":"a","color":"4278255873","region_ids":[{"id":"5"},{"id":"2"}]}]}')
    got = sorted(tuple(r) for r in ct.read_project(spark, str(tmp_path / "p.json")).collect())
    assert got == [("a", 1, 1, 1, 2), ("a", 1, 1, 1, 5)]
