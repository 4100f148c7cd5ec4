"""One file a frame: messages as text or wire bytes, id images and painted images.

Content is made by plans, one row (``name``, ``content``) a frame; ``FileSink`` writes such rows
as files, each task its own, in a folder that all machines share.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.sources.container import FRAME, decode


def text_form(message: dict, schema: dict = FRAME, depth: int = 0) -> str:
    """Text form of a message: fields by number, nested ones in braces; absent ones are left out."""
    pad, out = "  " * depth, []
    for name, (_, kind, repeated) in sorted(schema.items(), key=lambda x: x[1][0]):
        value = message.get(name)
        for v in (value or []) if repeated else [] if value is None else [value]:
            if isinstance(kind, dict):
                out.append(f"{pad}{name} {{\n{text_form(v, kind, depth + 1)}{pad}}}\n")
            elif "float" in kind:
                out.append(f"{pad}{name}: {np.float32(v):.9g}\n")
            else:
                out.append(f"{pad}{name}: {int(v)}\n")
    return "".join(out)


def png(image: np.ndarray) -> bytes:
    """PNG of an 8-bit image, height x width x 3 in red, green, blue, or height x width."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1).astype(np.uint8)], axis=1)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">2I5B", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def files(frames: DataFrame, text: bool = False) -> DataFrame:
    """(name, content) of (frame, message) rows: wire bytes, or text."""
    if not text:
        return frames.select(F.format_string("frame%05d.pb", "frame").alias("name"), F.col("message").alias("content"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"name": [f"frame{k:05d}.pbtxt" for k in part["frame"]], "content": [text_form(decode(bytes(m))).encode() for m in part["message"]]})

    return frames.select("frame", "message").mapInPandas(run, "name string, content binary")


def images(intervals: DataFrame, width: int, height: int, colours: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """(name, content): PNG of each frame with its intervals (frame, y, left_x, right_x) filled
    with their colours; what no interval covers stays black."""

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width, 3), np.uint8)
        for y, a, b, *c in pdf[["y", "left_x", "right_x", *colours]].itertuples(index=False, name=None):
            image[y, a : b + 1] = c
        return pd.DataFrame({"name": [f"frame{int(pdf['frame'].iloc[0]):05d}.png"], "content": [png(image)]})

    return intervals.select("frame", "y", "left_x", "right_x", *colours).groupBy("frame").applyInPandas(paint, "name string, content binary")


def id_images(intervals: DataFrame, width: int, height: int, region: str = "region_id") -> DataFrame:
    """PNG of each frame whose pixels hold the low 24 bits of their region's id, lowest byte
    in the blue channel."""
    part = lambda n: F.shiftright(F.col(region), n).bitwiseAND(255)
    return images(intervals.withColumns({"c0": part(16), "c1": part(8), "c2": part(0)}), width, height)


class FileSink(DataSource):
    """``df.write.format("tessera_files")``: each (name, content) row becomes a file of its own
    under ``path``, a folder that all machines share. Files appear whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "tessera_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            held = f"{self.path}/.{uuid.uuid4().hex}"
            with open(held, "wb") as f:
                f.write(bytes(row["content"]))
            os.replace(held, f"{self.path}/{row['name']}")
        return WriterCommitMessage()
