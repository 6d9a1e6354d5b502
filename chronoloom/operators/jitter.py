"""Packets through a jitter buffer: order, loss, release, and the delays it adds.

What a packet meets depends on every packet before it, so these are ordered
folds: a track's packets come in order of arrival and stream through one task,
with as much state as the buffer holds.  Tracks spread over tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import clock
from ..session import workers_import
from .folds import fold
from .ordered import as_of


class JitterBuffer:
    """Packets by number; gives (event, number, row) where event is packet, lost, late or replaced.

    The packet that is expected next leaves at once.  Anything else waits until
    the times that wait span ``size``; then the least number leaves, after a
    loss for each number that is skipped.  What comes below the expected number
    is late and dropped.
    """

    def __init__(self, size: int):
        self.size, self.expected = size, None
        self.rows: dict[int, tuple[int, object]] = {}
        self.numbers: list[int] = []
        self.low: list[tuple[int, int]] = []
        self.high: list[tuple[int, int]] = []

    def _end(self, heap: list[tuple[int, int]], sign: int) -> int:
        """The least or greatest time that waits; what has left or was replaced is cleared on the way."""
        while (held := self.rows.get(heap[0][1])) is None or sign * held[0] != heap[0][0]:
            heapq.heappop(heap)
        return sign * heap[0][0]

    def _leave(self) -> Iterator[tuple[str, int, object]]:
        """The least number that waits, and the losses before it."""
        number = heapq.heappop(self.numbers)
        for missing in range(number if self.expected is None else self.expected, number):
            yield "lost", missing, None
        self.expected = number + 1
        yield "packet", number, self.rows.pop(number)[1]

    def put(self, number: int, time: int, row: object) -> Iterator[tuple[str, int, object]]:
        if self.expected is not None and number < self.expected:
            yield "late", number, row
            return
        if number in self.rows:
            yield "replaced", number, self.rows[number][1]
        else:
            heapq.heappush(self.numbers, number)
        self.rows[number] = time, row
        heapq.heappush(self.low, (time, number))
        heapq.heappush(self.high, (-time, number))
        while self.rows and (self.numbers[0] == self.expected or self._end(self.high, -1) - self._end(self.low, 1) >= self.size):
            yield from self._leave()

    def close(self) -> Iterator[tuple[str, int, object]]:
        while self.rows:
            yield from self._leave()


def jitter(packets: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, nth, event, number, frame_id, seen_at): what comes out of each track's buffer, in order.

    ``packets``: number (unwrapped), pts, frame_id, arrival.  ``seen_at`` is
    the arrival that brought an event about, at the end of a track its last one.
    Equal numbers: the later packet replaces one that still waits.
    """
    workers_import(packets.sparkSession)
    names = [*keys, "nth", "event", "number", "frame_id", "seen_at"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, buffer, nth, last = None, None, 0, 0
        for rows in parts:
            out: list[tuple] = []

            def send(events, at, out=out):
                nonlocal nth
                for event, number, row in events:
                    out.append((*track, nth, event, number, row, at))
                    nth += 1

            for own, (number, pts, row, at) in zip(rows[keys].itertuples(index=False, name=None), rows[["number", "pts", "frame_id", "arrival"]].itertuples(index=False, name=None), strict=True):
                if own != track:
                    if buffer:
                        send(buffer.close(), last)
                    track, buffer, nth = own, JitterBuffer(size), 0
                send(buffer.put(number, pts, row), at)
                last = at
            yield _frame(out)
        if buffer:
            out = []
            for event, number, row in buffer.close():
                out.append((*track, nth, event, number, row, last))
                nth += 1
            yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({"frame_id": "Int64"})

    schema = T.StructType([*(packets.schema[k] for k in keys), *(T.StructField(n, T.StringType() if n == "event" else T.LongType()) for n in names[len(keys) :])])
    rows = packets.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("number", "pts", "frame_id", "arrival")])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "arrival", "frame_id").mapInPandas(run, schema)


def delayed(items: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Hold a stream back until what came spans more than ``size``, then let it through: adds released_at.

    ``items``: arrival (its order), start_pts, end_pts.  What still waits at
    the end leaves with the last arrival.  No window: the first row's time and
    two least arrivals of each stream are enough.
    """
    first = items.groupBy(*keys).agg(F.min_by("start_pts", F.struct("arrival", "start_pts")).alias("__first"), F.max("arrival").alias("__end"))
    spans = items.join(first, keys).where(F.abs(F.col("end_pts") - F.col("__first")) > size)
    ready = spans.groupBy(*keys).agg(F.min("arrival").alias("__ready"))
    out = items.join(first.drop("__first"), keys).join(ready, keys, "left")
    return out.withColumn("released_at", F.greatest("arrival", F.coalesce("__ready", "__end"))).drop("__ready", "__end")


class AdaptiveDelay:
    """A target delay that follows how early packets come, by six zones of their margin.

    Margins below the first limit jump the target by a second, at most once in
    ``JUMP_GAP``, else it grows fast; the next two zones grow it, above the
    comfortable zone it shrinks.  One packet in a growing or comfortable zone
    counts for ``LATCH``, the worst one first; shrinking takes a streak of
    ``STREAK``.  More than five jumps in ``RECURRENCE`` raise all limits but
    the first, at most twenty times.  Rates are parts of media time.
    """

    #: Fixed values.
    FLOOR, SPREAD = 80 * clock.MS, 2 * clock.NS
    LATCH, STREAK = 5 * clock.NS, 20 * clock.NS
    JUMP, JUMP_GAP = clock.NS, 4 * clock.NS
    RECURRENCE, JUMPS, BUMP, BUMPS = 240 * clock.NS, 5, 100 * clock.MS, 20
    RATES = (0.03, 0.03, 0.01, 0.0, -0.003, -0.01)

    def __init__(self, low: int = 80 * clock.MS, high: int = 500 * clock.MS):
        high = max(high, low + self.FLOOR)
        self.limits = [self.FLOOR, max(low - self.FLOOR, self.FLOOR), low, high, high + self.SPREAD]
        self.target = high
        self.seen: list[int | None] = [None] * 4  # when each zone up to the comfortable one was last met
        self.streak: list[int | None] = [None, None]  # since when margins are above it, and far above it
        self.top = self.jumped = None
        self.jumps: deque[int] = deque()
        self.bumps = 0

    def _observe(self, zone: int, pts: int) -> None:
        if zone < 4:
            self.seen[zone] = max(pts, self.seen[zone] if self.seen[zone] is not None else pts)
            self.streak = [None, None]
            return
        since, far = self.streak
        self.streak = [pts if since is None else since, None if zone == 4 else pts if far is None else far]

    def _zone(self, pts: int) -> int:
        """The zone that decides now."""
        for zone, at in enumerate(self.seen):
            if at is not None and pts - at < self.LATCH:
                return zone
        since, far = (at is not None and pts - at >= self.STREAK for at in self.streak)
        return 5 if far else 4 if since else 3

    def _jump(self, pts: int) -> None:
        self.jumped, self.target = pts, self.target + self.JUMP
        self.jumps.append(pts)
        while self.jumps[0] < max(0, pts - self.RECURRENCE):
            self.jumps.popleft()
        if len(self.jumps) > self.JUMPS:
            self.jumps.clear()
            if self.bumps < self.BUMPS:
                self.limits[1:] = [x + self.BUMP for x in self.limits[1:]]
                self.bumps += 1

    def __call__(self, pts: int, arrival: int) -> tuple[int]:
        self._observe(bisect_right(self.limits, max(0, pts + self.target - arrival)), pts)
        if self.top is None:
            self.top = self.jumped = pts  # no jump at the very start
        step, self.top = max(0, pts - self.top), max(self.top, pts)
        zone = self._zone(pts)
        jump = zone == 0 and max(0, pts - self.jumped) >= self.JUMP_GAP
        if jump:
            self._jump(pts)
        elif step and self.RATES[zone]:
            self.target = int(self.target * max(0.0, 1 + self.RATES[zone] * (step / clock.NS)) + 0.5)
        if zone == 0 or step and self.RATES[zone]:
            self.seen[:3] = [None] * 3  # these were measured against another target
        return (self.target,)


def adaptive(packets: DataFrame, keys: list[str], order: list[str], low: int = 80 * clock.MS, high: int = 500 * clock.MS) -> DataFrame:
    """Add target: the delay that packets so far call for. ``packets``: pts, arrival (ns)."""
    return fold(packets, keys, order, ["pts", "arrival"], [("target", T.LongType())], lambda: AdaptiveDelay(low, high))


class ClockSync:
    """Offset of a sender's clock: towards the newest report's by at most ``rate`` of media time, at once beyond ``snap`` seconds.

    ``resume``: where times follow the wall clock, a gap between arrivals that
    exceeds that of the stamps by more than this many seconds moves the offset
    by the difference.
    """

    def __init__(self, rate: float = 0.01, snap: float = 0.3, clock: float = 90_000.0, resume: float | None = None):
        self.rate, self.snap, self.clock, self.resume = rate, snap, clock, resume
        self.offset = self.first = self.top = self.target = self.arrival = None

    def __call__(self, stamp: int, arrival: float, report: float | None) -> tuple[float]:
        """``report``: the offset that a report implies, with the first packet after it."""
        if self.offset is None:
            self.offset, self.first, self.top = arrival, stamp, stamp
        elif report is not None and report == report:
            self.target = report
            if abs(report - self.offset) > self.snap:
                self.offset = report
        ahead = max(0, stamp - self.top) / self.clock
        if self.resume is not None and stamp > self.top and (skew := arrival - self.arrival - ahead) > self.resume:
            self.offset = self.target = self.offset + skew
        if self.target is not None:
            self.offset = max(self.offset - ahead * self.rate, min(self.offset + ahead * self.rate, self.target))
        self.top, self.arrival = max(self.top, stamp), arrival
        return (max(0.0, (stamp - self.first) / self.clock + self.offset),)


def report_targets(packets: DataFrame, reports: DataFrame, clock_rate: float) -> DataFrame:
    """(source, track, at, target): the offset in seconds that each report implies for its track.

    The first report of any track of a source fixes what its clock means: the
    time that this track's first packet came.  Reports before a track's first
    packet say nothing.  ``packets``: source, track, stamp, arrival (seconds);
    ``reports``: source, track, stamp, ntp (seconds), arrival.
    """
    first = packets.groupBy("source", "track").agg(F.min_by(F.struct("stamp", "arrival"), F.struct("arrival", "stamp")).alias("f"))
    rows = reports.join(first, ["source", "track"]).where(F.col("arrival") > F.col("f.arrival"))
    # when the track's first packet was sent, by the report's clock
    rows = rows.withColumn("sent", F.col("ntp") + (F.col("f.stamp") - F.col("stamp")) / F.lit(clock_rate))
    anchor = rows.groupBy("source").agg(F.min_by(F.col("sent") - F.col("f.arrival"), F.struct("arrival", "track")).alias("anchor"))
    return rows.join(anchor, "source").select("source", "track", F.col("arrival").alias("at"), (F.col("sent") - F.col("anchor")).alias("target"))


def synchronised(packets: DataFrame, reports: DataFrame, clock_rate: float = 90_000.0, resume: float | None = None, bucket: float = 3600.0) -> DataFrame:
    """Add pts_secs to ``packets`` (source, track, stamp, arrival in seconds, frame_id) from a source's reports."""
    keys = ["source", "track"]
    found = as_of(packets, report_targets(packets, reports, clock_rate), keys, "arrival", "at", ["target"], bucket, strict=True)

    class Track:
        def __init__(self):
            self.sync, self.seen = ClockSync(clock=clock_rate, resume=resume), None

        def __call__(self, stamp, arrival, at, target):
            new = at == at and at is not None and at != self.seen
            self.seen = at if new else self.seen
            return self.sync(stamp, arrival, target if new else None)

    return fold(found, keys, ["arrival", "frame_id"], ["stamp", "arrival", "at", "target"], [("pts_secs", T.DoubleType())], Track).drop("at", "target")
