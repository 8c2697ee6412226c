"""Parts of bursts of changes as state of a stream, finished by timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TIMES = [StructField(name, LongType()) for name in ("first_change", "last_change", "changes")]
#: Times are microseconds.
PART = StructType([StructField("repo", StringType()), *_TIMES])
OPEN_PARTS = "openParts"


def _micros(ts) -> int:
    return round(ts.timestamp() * 1_000_000)


class BurstParts(StatefulProcessor):
    """The open parts of one repository and split. Changes may come in any order within the watermark, so
    several parts can be open, and one change can make one of two. There is one timer, for the part that ends first:
    every call to the state or for a timer costs far more than a row."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState(OPEN_PARTS, StructType(_TIMES))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = [tuple(p) for p in self.open.get()]
        found = [(_micros(r.ts), _micros(r.ts), 1) for r in rows]
        kept: list[tuple[int, int, int]] = []
        for first, last, n in sorted([*before, *found]):
            if kept and first <= kept[-1][1] + self.gap * 1000:
                start, end, so_far = kept.pop()
                first, last, n = start, max(end, last), n + so_far
            kept.append((first, last, n))
        self.open.put(kept)
        old, new = self._next(before), self._next(kept)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        yield from ()

    def _due(self, last: int) -> int:
        """The first millisecond at which a change could no longer belong to a part that ends then."""
        return last // 1000 + self.gap + 1

    def _next(self, parts: list[tuple[int, int, int]]) -> int | None:
        return min((self._due(last) for _, last, _ in parts), default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All parts that the watermark has passed, whichever of them the timer was for.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        before = [tuple(p) for p in self.open.get()]
        kept = [p for p in before if self._due(p[1]) > now]
        if kept:
            self.open.put(kept)
            self.handle.registerTimer(self._next(kept))
        else:
            self.open.clear()
        for first, last, n in before:
            if self._due(last) <= now:
                yield Row(repo=key[0], first_change=first, last_change=last, changes=n)

    def close(self) -> None:
        pass
