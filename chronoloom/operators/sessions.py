"""Gaps, steps and islands in ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_lag, with_running_max, with_running_sum


def gaps(batches: DataFrame, keys: list[str], bucket: str, least: int = 50_000) -> DataFrame:
    """(keys, gap_start, gap_end) between a batch's end and the next one's start, from ``least`` ns on."""
    out = with_lag(batches, keys, bucket, ["start_pts", "end_pts"], {"__end": "end_pts"})
    return out.where(F.col("start_pts") - F.col("__end") >= least).select(*keys, F.col("__end").alias("gap_start"), F.col("start_pts").alias("gap_end"))


def moving_mean(rows: DataFrame, keys: list[str], bucket: str, ix: str, value: str, half: int, bucket_rows: int) -> DataFrame:
    """Mean over ``half`` rows on either side and the row itself, fewer at the ends: adds local_mean.

    ``ix`` numbers a stream's rows without gaps and ``bucket`` is ``ix div
    bucket_rows``.  Rows near an edge are sent to the bucket beyond it, too.
    """
    near = F.array(
        F.col(bucket),
        F.when((F.col(ix) % bucket_rows) < half, F.col(bucket) - 1),
        F.when((F.col(ix) % bucket_rows) >= bucket_rows - half, F.col(bucket) + 1),
    )
    spread = rows.withColumn("__to", F.explode(F.filter(near, lambda b: b.isNotNull())))
    w = Window.partitionBy(*keys, "__to").orderBy(ix).rowsBetween(-half, half)
    return spread.withColumn("local_mean", F.avg(value).over(w)).where(F.col("__to") == F.col(bucket)).drop("__to")


def step_flags(rows: DataFrame, keys: list[str], bucket: str, ix: str, value: str, half: int = 64, bucket_rows: int = 4096) -> DataFrame:
    """First differences and artefact flags: adds diff, local_mean, flag.

    A step is an artefact above 5 % of the stream's peak and above seven times
    the larger of the mean step around it and one.
    """
    peaks = rows.groupBy(*keys).agg(F.max(F.abs(F.col(value))).alias("__peak"))
    out = with_lag(rows, keys, bucket, [ix], {"__prev": value})
    out = out.withColumn("diff", F.coalesce(F.abs(F.col(value) - F.col("__prev")), F.lit(0.0))).drop("__prev")
    out = moving_mean(out, keys, bucket, ix, "diff", half, bucket_rows).join(peaks, keys)
    flag = (F.col("diff") > 0.05 * F.col("__peak")) & (F.col("diff") > 7 * F.greatest(F.col("local_mean"), F.lit(1.0)))
    return out.withColumn("flag", flag).drop("__peak")


def flag_intervals(rows: DataFrame, keys: list[str], bucket: str, ix: str, flag: Column, merge: int = 64) -> DataFrame:
    """Half-open runs of flagged rows, those less than ``merge`` apart as one: (keys, start_ix, end_ix, n)."""
    hits = rows.where(flag)
    out = with_lag(hits, keys, bucket, [ix], {"__prev": ix})
    new = F.coalesce((F.col(ix) - F.col("__prev") - 1 >= merge).cast("long"), F.lit(0))
    out = with_running_sum(out.withColumn("__new", new), keys, bucket, [ix], {"__run": F.col("__new")})
    return out.groupBy(*keys, "__run").agg(F.min(ix).alias("start_ix"), (F.max(ix) + 1).alias("end_ix"), F.count(F.lit(1)).alias("n")).drop("__run")


def merged_intervals(spans: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Overlapping or touching half-open spans as one: (keys, start, end)."""
    out = with_running_max(spans, keys, bucket, ["start", "end"], {"__top": F.col("end")})
    new = F.coalesce((F.col("start") > F.col("__top")).cast("long"), F.lit(0))
    out = with_running_sum(out.withColumn("__new", new), keys, bucket, ["start", "end"], {"__run": F.col("__new")})
    return out.groupBy(*keys, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def uncovered(spans: DataFrame, cover: DataFrame, keys: list[str], slack: int, bucket_ns: int) -> DataFrame:
    """Spans that no covering span, widened by ``slack`` on both sides, contains.

    Both sides are dealt out by the time buckets they touch, so the overlap
    test is an equality join.
    """
    wide = cover.select(*keys, (F.col("start") - slack).alias("c_start"), (F.col("end") + slack).alias("c_end"))
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ns), F.floor(F.col(b) / bucket_ns)))
    wide = wide.withColumn("__b", touched("c_start", "c_end"))
    left = spans.withColumn("__b", F.floor(F.col("start") / bucket_ns))
    hit = left.join(wide, [*keys, "__b"]).where("c_start <= start and c_end >= end").select(*spans.columns).distinct()
    return spans.join(hit, spans.columns, "left_anti")


def latest_state(events: DataFrame, keys: list[str], time: str, state: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(state, time).alias(state))


def debounced(events: DataFrame, keys: list[str], bucket: str, time: str, quiet: int, fields: list[str], tie: str) -> DataFrame:
    """Bursts with less than ``quiet`` ns between rows as one update, the last value of each field winning."""
    out = with_lag(events, keys, bucket, [time, tie], {"__prev": time})
    new = F.coalesce((F.col(time) - F.col("__prev") >= quiet).cast("long"), F.lit(0))
    out = with_running_sum(out.withColumn("__new", new), keys, bucket, [time, tie], {"burst": F.col("__new")})
    last = lambda f: F.max_by(f, F.struct(time, tie)).alias(f)
    return out.groupBy(*keys, "burst").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), *[last(f) for f in fields])
