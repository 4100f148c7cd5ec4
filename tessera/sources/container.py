"""The indexed binary container of segmentation results, its messages, and flow files.

Layout (little endian): HEAD, count, flags; per chunk CHNK, id, frames, offsets, pts, next
header; per frame SEGD, size, message; TERM, chunks. Reading goes through Spark's binary
files, so any store that Spark reads will do; each file is indexed and cut into frame rows
by one task, and a filter on ``frame`` is applied before any message is decoded.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Message fields as name -> (number, kind, repeated). A dict is a nested message.
INTERVAL = {"y": (1, "int", False), "left_x": (2, "int", False), "right_x": (3, "int", False)}
RASTER = {"scan_inter": (1, INTERVAL, True)}
MOMENTS = {n: (k, "float", False) for k, n in enumerate(("size", "mean_x", "mean_y", "moment_xx", "moment_xy", "moment_yy"), 1)}
POLYGON = {"coord_idx": (1, "packed_int", True), "hole": (2, "int", False)}
REGION = {"id": (1, "int", False), "raster": (3, RASTER, False), "shape_moments": (5, MOMENTS, False), "vectorization": (6, {"polygon": (1, POLYGON, True)}, False)}
COMPOUND = {"id": (1, "int", False), "size": (2, "int", False), "neighbor_id": (3, "int", True), "parent_id": (4, "int", False), "child_id": (5, "int", True), "start_frame": (6, "int", False), "end_frame": (7, "int", False)}
FRAME = {
    "region": (2, REGION, True), "hierarchy": (3, {"region": (2, COMPOUND, True)}, True), "frame_width": (4, "int", False), "frame_height": (5, "int", False),
    "chunk_size": (6, "int", False), "overlap_start": (7, "int", False), "chunk_id": (8, "int", False), "hierarchy_frame_idx": (9, "int", False),
    "vector_mesh": (11, {"coord": (1, "packed_float", True)}, False), "connectedness": (12, "int", False), "rasterization_removed": (13, "int", False),
}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(message: dict, schema: dict = FRAME) -> bytes:
    """Wire bytes of a message given as a dict; absent and None fields are left out."""
    out = []
    for name, (number, kind, repeated) in schema.items():
        value = message.get(name)
        if value is None or (repeated and len(value) == 0):
            continue
        if isinstance(kind, str) and kind.startswith("packed"):
            body = b"".join(map(_varint, value)) if kind == "packed_int" else np.asarray(value, "<f4").tobytes()
            out.append(_varint(number << 3 | 2) + _varint(len(body)) + body)
            continue
        for v in value if repeated else [value]:
            if kind == "int":
                out.append(_varint(number << 3) + _varint(int(v)))
            elif kind == "float":
                out.append(_varint(number << 3 | 5) + struct.pack("<f", v))
            else:
                body = encode(v, kind)
                out.append(_varint(number << 3 | 2) + _varint(len(body)) + body)
    return b"".join(out)


def _take(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def decode(data: bytes, schema: dict = FRAME) -> dict:
    """Message as a dict; unknown fields (extensions among them) are skipped."""
    by_number = {n: (name, kind, rep) for name, (n, kind, rep) in schema.items()}
    out: dict = {name: [] for name, (_, _, rep) in schema.items() if rep}
    at = 0
    while at < len(data):
        key, at = _take(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _take(data, at)
        elif wire == 5:
            value, at = data[at : at + 4], at + 4
        elif wire == 1:
            value, at = data[at : at + 8], at + 8
        else:
            n, at = _take(data, at)
            value, at = data[at : at + n], at + n
        if number not in by_number:
            continue
        name, kind, rep = by_number[number]
        if kind == "packed_float":
            out[name] += np.frombuffer(value, "<f4").tolist()
        elif kind == "packed_int" and wire == 2:
            k = 0
            while k < len(value):
                v, k = _take(value, k)
                out[name].append(_signed(v))
        else:
            v = _signed(value) if wire == 0 else struct.unpack("<f", value)[0] if kind == "float" else decode(value, kind)
            if rep:
                out[name].append(v)
            else:
                out[name] = v
    return out


def pack(frames: list[tuple[int, bytes]], chunk: int | None = None, flags: tuple[int, ...] = (1, 0)) -> bytes:
    """Container bytes of (pts, message) frames; ``chunk`` frames a chunk, or one chunk."""
    out = [b"HEAD" + struct.pack(f"<i{len(flags)}i", len(flags), *flags)]
    at, step = len(out[0]), chunk or max(1, len(frames))
    parts = [frames[k : k + step] for k in range(0, len(frames), step)]
    for i, part in enumerate(parts):
        n = len(part)
        first = at + 12 + 16 * n + 8
        offsets = np.cumsum([first, *(8 + len(m) for _, m in part)])
        out.append(b"CHNK" + struct.pack("<ii", i, n) + struct.pack(f"<{n}q", *offsets[:-1]) + struct.pack(f"<{n}q", *(p for p, _ in part)) + struct.pack("<q", offsets[-1]))
        out += [b"SEGD" + struct.pack("<i", len(m)) + m for _, m in part]
        at = int(offsets[-1])
    out.append(b"TERM" + struct.pack("<i", len(parts)))
    return b"".join(out)


def index(data: bytes) -> list[tuple[int, int, int, int]]:
    """(frame, chunk, pts, offset) of every frame, from the headers alone."""
    if data[:4] != b"HEAD":
        raise ValueError("no container header")
    at, out, want = 8 + 4 * struct.unpack_from("<i", data, 4)[0], [], 0
    while data[at : at + 4] == b"CHNK":
        chunk, n = struct.unpack_from("<ii", data, at + 4)
        if chunk != want:
            raise ValueError(f"chunk {chunk} where {want} was due")
        offsets, pts = struct.unpack_from(f"<{n}q", data, at + 12), struct.unpack_from(f"<{n}q", data, at + 12 + 8 * n)
        out += [(len(out) + k, chunk, p, o) for k, (o, p) in enumerate(zip(offsets, pts))]
        at, want = struct.unpack_from("<q", data, at + 12 + 16 * n)[0], want + 1
    if data[at : at + 4] != b"TERM" or struct.unpack_from("<i", data, at + 4)[0] != want:
        raise ValueError("container is not terminated")
    return out


def frame_bytes(data: bytes, offset: int) -> bytes:
    if data[offset : offset + 4] != b"SEGD":
        raise ValueError(f"no frame at {offset}")
    n = struct.unpack_from("<i", data, offset + 4)[0]
    return data[offset + 8 : offset + 8 + n]


def read_frames(spark: SparkSession, path: str, frames: tuple[int, int] | None = None) -> DataFrame:
    """(path, frame, chunk_id, pts, message) of all containers under a path; ``frames``
    keeps a closed interval of frame numbers and skips the bytes of all others."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"]):
                rows = [(p, f, c, t, frame_bytes(data, o)) for f, c, t, o in index(data) if frames is None or frames[0] <= f <= frames[1]]
                yield pd.DataFrame(rows, columns=["path", "frame", "chunk_id", "pts", "message"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, frame int, chunk_id int, pts long, message binary")


def intervals(frames: DataFrame) -> DataFrame:
    """(path, frame, region_id, y, left_x, right_x) of the messages."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, f, r["id"], s["y"], s["left_x"], s["right_x"]) for p, f, m in zip(part["path"], part["frame"], part["message"])
                    for r in decode(m)["region"] for s in (r.get("raster") or {"scan_inter": []})["scan_inter"]]
            yield pd.DataFrame(rows, columns=["path", "frame", "region_id", "y", "left_x", "right_x"])

    return frames.select("path", "frame", "message").mapInPandas(explode, "path string, frame int, region_id int, y int, left_x int, right_x int")


def hierarchy(frames: DataFrame) -> DataFrame:
    """(path, frame, level, id, size, parent_id, start_frame, end_frame, neighbor_id, child_id)."""

    def explode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, f, k, r["id"], r["size"], r.get("parent_id", -1), r.get("start_frame"), r.get("end_frame"), r["neighbor_id"], r["child_id"])
                    for p, f, m in zip(part["path"], part["frame"], part["message"]) for k, level in enumerate(decode(m)["hierarchy"]) for r in level["region"]]
            yield pd.DataFrame(rows, columns=["path", "frame", "level", "id", "size", "parent_id", "start_frame", "end_frame", "neighbor_id", "child_id"])

    return frames.select("path", "frame", "message").mapInPandas(explode, "path string, frame int, level int, id int, size int, parent_id int, start_frame int, end_frame int, neighbor_id array<int>, child_id array<int>")


def messages(intervals_df: DataFrame, width: int, height: int) -> DataFrame:
    """(frame, message): one message per frame from interval rows, regions sorted by id."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        regions = [{"id": int(i), "raster": {"scan_inter": g.sort_values(["y", "left_x"])[["y", "left_x", "right_x"]].to_dict("records")}} for i, g in pdf.groupby("region_id")]
        return pd.DataFrame({"frame": [int(pdf["frame"].iloc[0])], "message": [encode({"region": regions, "frame_width": width, "frame_height": height})]})

    return intervals_df.groupBy("frame").applyInPandas(build, "frame int, message binary")


def strip(message: dict, vectors: bool = False, moments: bool = False) -> bytes:
    """Compact form of a frame: size, optional mesh, regions, hierarchy without neighbours."""
    i4, i2 = (lambda *v: struct.pack(f"<{len(v)}i", *map(int, v))), (lambda *v: struct.pack(f"<{len(v)}h", *map(int, v)))
    out = [i4(message.get("frame_width", 0), message.get("frame_height", 0))]
    if vectors:
        coord = message["vector_mesh"]["coord"]
        if len(coord) >= 1 << 15:
            raise ValueError("too many points")
        out += [i4(len(coord)), i2(*coord)]
    out.append(i4(len(message["region"])))
    for r in message["region"]:
        if vectors:
            polygons = (r.get("vectorization") or {"polygon": []})["polygon"]
            out.append(i4(r["id"], len(polygons)))
            out += [i2(len(p["coord_idx"])) + bytes([int(p.get("hole", 0))]) + i2(*p["coord_idx"]) for p in polygons]
        else:
            rows = (r.get("raster") or {"scan_inter": []})["scan_inter"]
            out.append(i4(r["id"], len(rows)) + b"".join(i2(s["y"], s["left_x"], s["right_x"]) for s in rows))
        if moments:
            m = r.get("shape_moments") or {}
            out.append(i4(*(m.get(n, 0) for n in MOMENTS)))
    out.append(i4(len(message["hierarchy"])))
    for level in message["hierarchy"]:
        out.append(i4(len(level["region"])))
        for r in level["region"]:
            out.append(i4(r["id"], r["size"], r.get("parent_id", -1), len(r["child_id"]), *r["child_id"], r.get("start_frame", 0), r.get("end_frame", 0)))
    return b"".join(out)


class ContainerSink(DataSource):
    """``df.write.format("tessera_container")``: each partition of (frame, pts, message)
    rows becomes one container in a folder that all machines share. Options: ``path``,
    ``chunk`` (frames a chunk; one chunk a file if absent). Repartition by video first."""

    @classmethod
    def name(cls) -> str:
        return "tessera_container"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ContainerWriter(self.options["path"], int(self.options.get("chunk", 0)) or None)


class _ContainerWriter(DataSourceWriter):
    def __init__(self, path: str, chunk: int | None):
        self.path, self.chunk = path, chunk

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        frames = sorted(((r["frame"], r["pts"], bytes(r["message"])) for r in rows), key=lambda x: x[0])
        if frames:
            os.makedirs(self.path, exist_ok=True)
            name = f"{self.path}/{uuid.uuid4().hex}.pb"
            with open(name + ".tmp", "wb") as f:
                f.write(pack([(p, m) for _, p, m in frames], self.chunk))
            os.replace(name + ".tmp", name)
        return WriterCommitMessage()


def pack_flow(width: int, height: int, images: list[np.ndarray], kind: int = 1) -> bytes:
    """Flow file: width, height, type, then float32 (x, y) images; frame 0 has none."""
    return struct.pack("<3i", width, height, kind) + b"".join(np.asarray(i, "<f4").tobytes() for i in images)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, y, x, fx, fy) of flow files; the first image belongs to frame 1."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"]):
                w, h, kind = struct.unpack_from("<3i", data)
                step = 2 if kind == 2 else 1
                flat = np.frombuffer(data, "<f4", offset=12)
                images = flat[: len(flat) // (2 * w * h) * 2 * w * h].reshape(-1, h, w, 2)[::step]
                for k, image in enumerate(images):
                    y, x = np.mgrid[:h, :w]
                    yield pd.DataFrame({"path": p, "frame": k + 1, "y": y.ravel(), "x": x.ravel(), "fx": image[..., 0].ravel(), "fy": image[..., 1].ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "path string, frame int, y int, x int, fx float, fy float")


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """(name, r, g, b, region_id) of project files: labels with a packed colour and ids."""
    schema = "labels array<struct<name:string,color:string,region_ids:array<struct<id:string>>>>"
    label = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("labels").alias("l"))
    colour = F.col("l.color").cast("bigint")
    part = lambda n: F.shiftright(colour, n).bitwiseAND(255).cast("int")
    return label.select("l.name", part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), F.explode("l.region_ids").alias("i")).select("name", "r", "g", "b", F.col("i.id").cast("int").alias("region_id"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark resolves it to."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
