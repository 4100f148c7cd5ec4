"""A tree of named stages over one stream of frame rows: schema first, then data.

Each unit declares the columns it adds (``opens``) and a stage DataFrame -> DataFrame; the
tree is checked once (names unique, needs met) and applied to a batch or streaming frame.
Branches share their parent's plan. A unit may also be a sink.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Unit:
    name: str
    stage: Stage = lambda df: df
    opens: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    children: list["Unit"] = field(default_factory=list)
    parent: "Unit | None" = field(default=None, repr=False)

    def attach_to(self, parent: "Unit") -> "Unit":
        if self.parent is not None:
            raise ValueError(f"{self.name} has a parent")
        parent.children.append(self)
        self.parent = parent
        return self

    def remove(self) -> "Unit":
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None
        return self

    def root(self) -> "Unit":
        return self if self.parent is None else self.parent.root()

    def has(self, other: "Unit") -> bool:
        return any(c is other or c.has(other) for c in self.children)

    def downstream(self) -> list["Unit"]:
        return [u for c in self.children for u in (c, *c.downstream())]

    def show(self, depth: int = 0) -> str:
        return "\n".join(["  " * depth + self.name, *(c.show(depth + 1) for c in self.children)])

    def open_streams(self, streams: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
        """Columns after each unit; raises on a duplicate or a missing one."""
        twice = [s for s in self.opens if s in streams]
        missing = [s for s in self.needs if s not in streams]
        if twice or missing:
            raise ValueError(f"{self.name}: duplicate {twice}, missing {missing}")
        now = (*streams, *self.opens)
        out = {self.name: now}
        for c in self.children:
            for name, cols in c.open_streams(now).items():
                if name in out:
                    raise ValueError(f"two units named {name}")
                out[name] = cols
        return out

    def run(self, frames: DataFrame) -> dict[str, DataFrame]:
        """Plan of every unit by name; columns must be those that were opened."""
        want = self.open_streams(tuple(frames.columns))
        return self._run(frames, want)

    def _run(self, frames: DataFrame, want: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
        df = self.stage(frames)
        if tuple(df.columns) != want[self.name]:
            raise ValueError(f"{self.name} gives {df.columns}, it opened {want[self.name]}")
        out = {self.name: df}
        for c in self.children:
            out.update(c._run(df, want))
        return out


def stream_index(name: str, columns: list[str]) -> int:
    """Place of a stream, -1 if it is absent."""
    return columns.index(name) if name in columns else -1


def start_all(plans: dict[str, DataFrame], leaves: list[str], checkpoint: str, trigger: dict | None = None) -> list[StreamingQuery]:
    """One memory query per leaf; the caller awaits or stops them together."""
    return [
        plans[n].writeStream.format("memory").queryName(n).option("checkpointLocation", f"{checkpoint}/{n}").trigger(**(trigger or {"availableNow": True})).start()
        for n in leaves
    ]


def join_all(queries: list[StreamingQuery], timeout: float | None = None) -> bool:
    """Wait for every query; on a failure of one the others are stopped before it is raised.
    False if the time (seconds, for each) ran out first."""
    try:
        return all([q.awaitTermination(timeout) if timeout else q.awaitTermination() or True for q in queries])
    except Exception:
        for q in queries:
            q.stop()
        raise


def scaled_rate(max_rate: float, backlog: int, threshold: int, step: int = 10, scale: float = 1.0) -> float:
    """Rate of a source: halved for every ``step`` frames of backlog above the threshold, a
    fifth of the maximum at least."""
    return max_rate * scale * max(0.2, 0.5 ** (max(0, backlog - threshold) / step))


def slowest_and_longest(progress: list[dict]) -> tuple[float, int]:
    """Smallest processing rate and largest input batch over the progress of many queries."""
    return (min((p.get("processedRowsPerSecond", 0.0) for p in progress), default=0.0), max((p.get("numInputRows", 0) for p in progress), default=0))


def seek(frames: DataFrame, pts: int, column: str = "pts") -> DataFrame:
    """Frames from a presentation time on; the filter reaches the scan."""
    return frames.filter(F.col(column) >= pts)
