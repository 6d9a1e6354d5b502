"""Time as 64-bit nanoseconds: conversions, saturating arithmetic and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS = 1_000_000_000
MS = 1_000_000
HOUR, DAY = 3600 * NS, 86_400 * NS
#: Length of an audio chunk, and how much earlier a chunk takes its batches.
CHUNK, STRETCH = 20 * MS, 80 * MS


def ns_of(ts: str | Column, origin_day: str = "2024-01-01") -> Column:
    """Nanoseconds from the start of a day to a timestamp without time zone.

    Taken from calendar fields, so the session's time zone doesn't matter.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.unix_date(F.to_date(c)) - F.unix_date(F.lit(origin_day).cast("date"))
    micros = F.round(F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return days.cast("long") * DAY + F.hour(c) * HOUR + F.minute(c) * (60 * NS) + micros * 1000


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def seconds(ns: Column) -> Column:
    return ns / F.lit(float(NS))


def sample_count(start: Column, end: Column, rate: int) -> Column:
    """Whole samples in a range, by integer division."""
    wide = saturating_sub(end, start).cast("decimal(38,0)") * F.lit(rate)
    return F.floor(wide / F.lit(NS)).cast("long")


def slot_grid(spark: SparkSession, start: int, end: int, num: int, den: int = 1) -> DataFrame:
    """(slot_ix, slot_pts): slots from start up to before end at num/den a second."""
    count = max(0, -(-(end - start) * num // (den * NS)))
    pts = F.lit(start) + F.floor(F.col("id").cast("double") * den / num * NS).cast("long")
    return spark.range(count).select(F.col("id").alias("slot_ix"), pts.alias("slot_pts"))


def period_grid(spark: SparkSession, start: int, end: int, period: int) -> DataFrame:
    """(slot_ix, slot_pts) every ``period`` ns from start up to before end."""
    return spark.range(max(0, -(-(end - start) // period))).select(F.col("id").alias("slot_ix"), (F.lit(start) + F.col("id") * period).alias("slot_pts"))


def chunk_of(pts: Column, start: int = 0, size: int = CHUNK) -> Column:
    """Index of the half-open chunk that a time is in."""
    return F.floor((pts - F.lit(start)) / F.lit(size)).cast("long")
