"""Count-based chunks over a stream of frames, with state per video.

Spark's windows are by time; these are by frame count, so the counter and the frames of the
unfinished chunk live in keyed state. A finished chunk leaves the state at once, so what is
held is less than one chunk per video.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def overlap(size: int, fraction: float = 0.2) -> int:
    """Frames two chunks share: at most two."""
    return min(int(fraction * size + 0.5), 2)


def stride(size: int) -> int:
    """Frames a chunk of ``size`` gives out."""
    if size < 8:
        raise ValueError("a chunk needs 8 frames at least")
    return size - overlap(size) + 1


def chunk_columns(frame: Column, size: int = 20) -> dict[str, Column]:
    """Closed forms: chunk of a frame, and the frame that carries its hierarchy."""
    n = stride(size)
    chunk = F.floor(frame / n).cast("int")
    return {"chunk_id": chunk, "hierarchy_frame_idx": (chunk * n).cast("int")}


def chunk_set(chunk: Column, chunks: Column, size: int = 6, look: int = 2) -> Column:
    """Chunk set of a chunk among ``chunks`` in all."""
    return F.least(F.floor((chunk + look + 1) / size), F.floor(chunks / size)).cast("int")


def min_region_size(width: int, height: int, size: int = 20, fraction: float = 0.01) -> int:
    return int(fraction * width * fraction * height * size)


def in_chunks(frames: DataFrame, per_chunk: Callable[[int, int, pd.DataFrame], pd.DataFrame], schema: str, size: int = 20,
              key: str = "video_id", order: str = "pts", idle: str | None = None, final: str | None = None, carry: bool = False) -> DataFrame:
    """Apply ``per_chunk(video, chunk, rows)`` to each chunk of ``stride(size)`` frames.

    Frames of a video are numbered as they come; within one micro-batch by ``order``. A late
    frame (not after the last one seen) is dropped, as frames must increase. With ``idle``,
    a processing-time span, a video that has been silent for so long flushes its rest. With
    ``final``, a boolean column, the frame where it is true ends its video: what is left of the
    last chunk comes out at once and the video's state goes. With ``carry``, ``per_chunk`` gets
    what it returned for the chunk before as a fourth argument (None at first) and returns a
    pair, the rows and what the next chunk is to get.
    """
    n = stride(size)
    columns = frames.columns

    def run(group, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last, held = (state.get if state.exists else (0, None, b""))
        rest, carried = pickle.loads(held) if held else ([], None)

        def done(chunk: int) -> pd.DataFrame:
            nonlocal carried
            frame = pd.DataFrame(rest, columns=["frame", *columns])
            if not carry:
                return per_chunk(group[0], chunk, frame)
            out, carried = per_chunk(group[0], chunk, frame, carried)
            return out

        if state.hasTimedOut:
            if rest:
                yield done((number - 1) // n)
            state.remove()
            return
        new = pd.concat(list(parts)).sort_values(order, kind="stable")
        at = columns.index(order)
        seen, ended = None, False
        for row in new.itertuples(index=False, name=None):
            if last is not None and row[at] <= last and row[at] != seen:
                continue
            if row[at] != seen and ended:
                break
            if row[at] != seen:
                seen = last = row[at]
                number += 1
                if (number - 1) % n == 0 and rest:
                    yield done((number - 2) // n)
                    rest = []
            rest.append((number - 1, *row))
            ended = ended or bool(final and row[columns.index(final)])
        if ended:
            yield done((number - 1) // n)
            state.remove()
            return
        state.update((number, last, pickle.dumps((rest, carried))))
        if idle:
            state.setTimeoutDuration(int(pd.Timedelta(idle).total_seconds() * 1000))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.groupBy(key).applyInPandasWithState(run, schema, "number long, last long, held binary", "append", timeout)


def all_chunks(frames: DataFrame, per_chunk: Callable[[int, int, pd.DataFrame], pd.DataFrame], schema: str, size: int = 20,
               key: str = "video_id", frame: str = "frame") -> DataFrame:
    """The same over a finished table of numbered frames: every chunk, the last partial one
    included, is one group."""
    n = stride(size)
    return frames.withColumn("__chunk", F.floor(F.col(frame) / n).cast("long")).groupBy(key, "__chunk").applyInPandas(
        lambda at, rows: per_chunk(at[0], int(at[1]), rows.drop(columns="__chunk").sort_values(frame)), schema)


def rate_table(frames: DataFrame, watermark: str | None = None, window: str = "1 second", time: str = "ts") -> DataFrame:
    """Frames per video and event-time window; with a watermark late rows are dropped."""
    src = frames.withWatermark(time, watermark) if watermark else frames
    return src.groupBy("video_id", F.window(time, window)).agg(F.count(F.lit(1)).alias("frames"))
