"""Structured Streaming forms of the batch operators.

Event time comes as nanoseconds; ``withWatermark`` needs a timestamp, so that
is derived once and both are kept.  Every function takes a streaming frame and
returns one; :func:`drain` runs it over what is there and returns the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_dir, workers_import

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Rows that a fold with state returns at a time.
_ROWS = 1 << 16


def frames(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Events as a stream of frames, one file after the other."""
    from ..clock import ns_of

    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(folder)
    pts = ns_of("ts")
    return rows.select(F.col("event_type").alias("input_id"), F.col("event_id").alias("frame_id"), pts.alias("pts"), F.timestamp_micros((pts / 1000).cast("long")).alias("at"), F.col("value").alias("payload"), "user_id")


def tumbling(stream: DataFrame, length: str, delay: str) -> DataFrame:
    """Counts and sums of each input's windows, sent once the watermark has passed them."""
    w = stream.withWatermark("at", delay).groupBy(F.window("at", length).alias("w"), "input_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("payload"), 4).alias("total")).select("input_id", F.unix_micros("w.start").alias("start_us"), "n", "total")


def sliding(stream: DataFrame, length: str, step: str, delay: str) -> DataFrame:
    """Overlapping windows: each row is in all windows that cover it."""
    w = stream.withWatermark("at", delay).groupBy(F.window("at", length, step).alias("w"), "input_id")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("payload").alias("high")).select("input_id", F.unix_micros("w.start").alias("start_us"), "n", "high")


def sessions(stream: DataFrame, key: str, gap: str, delay: str) -> DataFrame:
    w = stream.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), key)
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def newest_at_slots(stream: DataFrame, period_us: int, delay: str) -> DataFrame:
    """For each input and slot the newest frame of the slot's own period: the live form of sampling."""
    own = stream.withWatermark("at", delay).groupBy(F.window("at", f"{period_us} microseconds").alias("w"), "input_id")
    return own.agg(F.max(F.struct("pts", "frame_id")).alias("m")).select("input_id", F.unix_micros("w.end").alias("slot_us"), F.col("m.frame_id").alias("frame_id"))


def by_required(stream: DataFrame, required: list[str], delay: str) -> DataFrame:
    """Frames under a watermark that only required inputs move, the slowest of them.

    Each required input has a watermark of its own, of which the session takes
    the least (the default policy); the rows of all others join without one and
    count as long as they come in time.
    """
    out = None
    for name in required:
        own = stream.where(F.col("input_id") == name).withWatermark("at", delay)
        out = own if out is None else out.unionByName(own)
    return out.unionByName(stream.where(~F.col("input_id").isin(*required)))


def newest_when_ready(stream: DataFrame, required: list[str], period_us: int, delay: str) -> DataFrame:
    """:func:`newest_at_slots`, a slot being sent once every required input has newer frames."""
    own = by_required(stream, required, delay).groupBy(F.window("at", f"{period_us} microseconds").alias("w"), "input_id")
    return own.agg(F.max(F.struct("pts", "frame_id")).alias("m")).select("input_id", F.unix_micros("w.end").alias("slot_us"), F.col("m.frame_id").alias("frame_id"))


def in_order(stream: DataFrame, hold: int, delay: str = "0 seconds") -> DataFrame:
    """Packets of each track by number: released once one ``hold`` higher was seen, dropped if too late.

    ``stream``: track, number (unwrapped), at (when it arrived, so that no
    packet is behind the watermark).  Packets of one micro-batch come together,
    in whatever order they are read: a packet is late by what earlier batches
    brought.  Of packets that wait under one number one is released.  State is
    what waits, at most the numbers within ``hold`` of the highest, and the
    highest; a task holds a batch's numbers of a track in arrays.  Once the
    watermark has passed a track's last packet, what waits is released.
    """
    workers_import(stream.sparkSession)

    def rows_of(track: str, numbers: np.ndarray, late: bool) -> Iterator[pd.DataFrame]:
        for lo in range(0, max(1, len(numbers)), _ROWS):
            yield pd.DataFrame({"track": track, "number": numbers[lo : lo + _ROWS], "late": late})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, top = (np.array(state.get[0], np.int64), state.get[1]) if state.exists else (np.empty(0, np.int64), -1)
        if state.hasTimedOut:
            state.update(([], top))
            yield from rows_of(key[0], np.sort(waiting), False)
            return
        last, came = 0, []
        for rows in batches:
            last = max(last, int(rows["at"].max().timestamp() * 1000))
            came.append(rows["number"].to_numpy(np.int64))
        numbers = np.concatenate(came)
        late = numbers < top - hold
        waiting = np.unique(np.concatenate([waiting, numbers[~late]]))
        top = max([top, *waiting[-1:].tolist()])
        ready = np.searchsorted(waiting, top - hold)
        state.update((waiting[ready:].tolist(), top))
        state.setTimeoutTimestamp(max(last - 1, state.getCurrentWatermarkMs() + 1))
        yield from rows_of(key[0], np.sort(numbers[late]), True)
        yield from rows_of(key[0], waiting[:ready], False)

    rows = stream.select("track", "number", "at").withWatermark("at", delay)
    return rows.groupBy("track").applyInPandasWithState(step, "track string, number long, late boolean", "waiting array<long>, top long", "append", GroupStateTimeout.EventTimeTimeout)


def ticks(spark: SparkSession, period_ms: int, per_batch: int = 200) -> DataFrame:
    """A stream of timer ticks from zero on: (tick, tick_ms); a batch brings ``per_batch`` of them.

    Ticks count time by their number, so a run that starts again goes on where it was.
    """
    rows = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).option("startTimestamp", 0).option("advanceMillisPerBatch", period_ms * per_batch).option("numPartitions", 1).load()
    return rows.select(F.col("value").alias("tick"), (F.col("value") * period_ms).alias("tick_ms"))


def due(timer: DataFrame, period_ms: int, num: int, den: int = 1) -> DataFrame:
    """The slots of a num/den a second grid that fall due at each tick, each at one tick: (tick_ms, slot_ix, slot_pts)."""
    # slots up to a tick: those whose time is at most the tick's
    upto = lambda ms: F.floor(ms * F.lit(num) / F.lit(den * 1000.0)).cast("long")
    first, last = F.when(F.col("tick") == 0, F.lit(-1).cast("long")).otherwise(upto(F.col("tick_ms") - period_ms)) + 1, upto(F.col("tick_ms"))
    slots = timer.where(last >= first).select("tick_ms", F.explode(F.sequence(first, last)).alias("slot_ix"))
    return slots.withColumn("slot_pts", F.floor(F.col("slot_ix").cast("double") * den / num * 1_000_000_000).cast("long"))


def drain(stream: DataFrame, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return its rows, which go to a table in the shared folder."""
    folder = shared_dir(stream.sparkSession, "drained")
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
    return transform(out) if transform else out


def write_segments(stream: DataFrame, folder: str, period_ns: int, checkpoint: str):
    """A sink with a folder for each segment of time."""
    cut = stream.withColumn("segment", F.floor(F.col("pts") / period_ns).cast("long"))
    return cut.writeStream.format("parquet").partitionBy("segment").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
