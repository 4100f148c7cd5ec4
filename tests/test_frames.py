"""Files of frames: text form, wire bytes, images."""

import os
import struct
import zlib

import numpy as np

from tessera.sources import container as ct
from tessera.sources import frames as fr

MESSAGE = {"region": [{"id": 3, "raster": {"scan_inter": [{"y": 0, "left_x": 1, "right_x": 4}]}, "shape_moments": {"size": 5.0, "mean_x": 1.5}}],
           "hierarchy": [{"region": [{"id": 3, "size": 5, "neighbor_id": [1, 9], "parent_id": -1}]}], "frame_width": 640}
TEXT = """region {
  id: 3
  raster {
    scan_inter {
      y: 0
      left_x: 1
      right_x: 4
    }
  }
  shape_moments {
    size: 5
    mean_x: 1.5
  }
}
hierarchy {
  region {
    id: 3
    size: 5
    neighbor_id: 1
    neighbor_id: 9
    parent_id: -1
  }
}
frame_width: 640
"""


def pixels(data):
    """Image of an unfiltered 8-bit RGB PNG."""
    w, h, depth, kind = struct.unpack_from(">2I2B", data, 16)
    n = struct.unpack_from(">I", data, 33)[0]
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + n]), np.uint8).reshape(h, 1 + 3 * w)
    assert (depth, kind) == (8, 2) and not raw[:, 0].any()
    return raw[:, 1:].reshape(h, w, 3)


def test_text_form():
    assert fr.text_form(ct.decode(ct.encode(MESSAGE))) == TEXT


def test_files_are_written_whole(spark, tmp_path):
    spark.dataSource.register(fr.FileSink)
    rows = spark.createDataFrame([(k, ct.encode({**MESSAGE, "frame_width": k})) for k in range(7)], "frame int, message binary")
    for text in (False, True):
        fr.files(rows, text).repartition(3).write.format("tessera_files").mode("append").option("path", str(tmp_path / "out")).save()
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"frame{k:05d}.{e}" for k in range(7) for e in ("pb", "pbtxt"))
    assert ct.decode((tmp_path / "out/frame00004.pb").read_bytes())["frame_width"] == 4
    assert (tmp_path / "out/frame00005.pbtxt").read_text() == TEXT.replace("640", "5")


def test_images_hold_colours_and_ids(spark):
    rows = [(0, 0, 0, 2, 70000), (0, 1, 1, 1, 258), (1, 1, 0, 2, 5)]
    df = spark.createDataFrame(rows, "frame int, y int, left_x int, right_x int, region_id int")
    got = {r["name"]: pixels(bytes(r["content"])) for r in fr.id_images(df, 3, 2).collect()}
    assert got["frame00000.png"].tolist() == [[[1, 17, 112]] * 3, [[0, 0, 0], [0, 1, 2], [0, 0, 0]]]
    assert got["frame00001.png"].tolist() == [[[0, 0, 0]] * 3, [[0, 0, 5]] * 3]
    assert fr.id_images(df.limit(0), 3, 2).count() == 0
