"""Adapters from tables to timed streams, and a registry of sources by name.

A stream is one table with ``input_id``, ``frame_id``, ``pts`` (ns) and what
the source measured.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..clock import ns_of

_SOURCES: dict[str, Callable[..., DataFrame]] = {}


class AlreadyRegistered(ValueError):
    pass


class NotRegistered(KeyError):
    pass


def register(kind: str, reader: Callable[..., DataFrame]) -> None:
    if kind in _SOURCES:
        raise AlreadyRegistered(kind)
    _SOURCES[kind] = reader


def unregister(kind: str) -> None:
    if kind not in _SOURCES:
        raise NotRegistered(kind)
    del _SOURCES[kind]


def open_source(spark: SparkSession, kind: str, **options) -> DataFrame:
    if kind not in _SOURCES:
        raise NotRegistered(kind)
    return _SOURCES[kind](spark, **options)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events as frames: one input for each event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("input_id"), F.col("event_id").alias("frame_id"), ns_of("ts").alias("pts"), F.col("value").alias("payload"), "user_id"
    )


def packets(spark: SparkSession, folder: str) -> DataFrame:
    """Frames as numbered packets, 16-bit numbers that wrap, some lost, some late.

    Packet n of a track is lost if its event id is a multiple of 97; arrival
    swaps neighbours of ids that are multiples of 50.
    """
    seq = (F.col("frame_id") + 60_000) % 65_536
    arrival = F.col("frame_id") + F.when(F.col("frame_id") % 50 == 0, 3).otherwise(0)
    return frames(spark, folder).where("frame_id % 97 <> 0").select(
        F.lit("track").alias("track"), arrival.alias("arrival"), seq.alias("seq"), ((F.col("pts") / 1000) % 4_294_967_296).cast("long").alias("rtp_ts"), "frame_id", "pts", "payload"
    )


def media_samples(samples: DataFrame, bucket: str, timescale: Column | int, delay: int = 0, seek: int = 0) -> DataFrame:
    """Times of a file's samples from their durations: adds dts and pts (ns).

    ``samples``: track, ix, duration and rendering_offset in units of the
    timescale.  ``delay`` comes from leading empty edits, ``seek`` from the
    point to play from; times don't go below zero.
    """
    from ..operators.ordered import with_running_sum

    out = with_running_sum(samples, ["track"], bucket, ["ix"], {"__end": F.col("duration")})
    start = F.col("__end") - F.col("duration")
    ns = lambda x: F.round(x * F.lit(1e9) / (timescale if isinstance(timescale, Column) else F.lit(timescale))).cast("long")
    pts = ns(start + F.col("rendering_offset")) + delay
    return out.withColumn("dts", ns(start)).withColumn("pts", F.greatest(pts - seek, F.lit(0).cast("long"))).drop("__end")


def nudged(packets: DataFrame, keys: list[str], bucket: str, order: list[str], step: int = 100_000, low: int = 6 * 1_000_000_000, high: int = 24 * 1_000_000_000) -> DataFrame:
    """Live packets whose anchor moves a little with each one while the buffer is too long or too short: adds out_pts.

    ``packets``: pts, buffered (ns).  The anchor starts at the stream's first
    time and is never below zero: a running sum that is held there.
    """
    from ..operators.ordered import with_running_max, with_running_sum

    first = packets.groupBy(*keys).agg(F.min_by("pts", F.struct(*order)).alias("__first"))
    move = F.when(F.col("buffered") > high, step).when(F.col("buffered") < low, -step).otherwise(0).cast("long")
    out = with_running_sum(packets.join(first, keys).withColumn("__move", move), keys, bucket, order, {"__moved": F.col("__move")})
    out = out.withColumn("__at", F.col("__first") + F.col("__moved"))
    out = with_running_max(out, keys, bucket, order, {"__under": -F.col("__at")})
    anchor = F.col("__at") + F.greatest(F.lit(0).cast("long"), F.coalesce("__under", F.lit(0)), -F.col("__at"))
    return out.withColumn("out_pts", F.greatest(F.lit(0).cast("long"), F.col("pts") - anchor)).drop("__first", "__move", "__moved", "__at", "__under")


def files(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Static assets (images and the like) as rows of path and bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


for _kind, _reader in {"frames": frames, "packets": packets, "files": files, "memory": memory, "assets": assets}.items():
    register(_kind, _reader)
