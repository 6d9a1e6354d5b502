"""Sliding and lifetime statistics of timed measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


#: How each aggregate of a window follows from those of its two parts.
_JOINED = {
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def _halves(x: Column) -> tuple[Column, Column]:
    """Two doubles that make up ``x``, the first of 24 bits: summed apart, long sums lose next to nothing."""
    fits = F.abs(x) < F.lit(1e38)
    high = F.when(fits, x.cast("float").cast("double")).otherwise(x)
    return high, F.when(fits, x - high).otherwise(F.lit(0.0))


def sliding(rows: DataFrame, keys: list[str], time: str, window_ns: int, aggregates: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add aggregates over the last ``window_ns``, both ends included.

    ``aggregates``: for each new column count, sum, avg (in doubles), min or max
    and of what.  A stream is cut into blocks of a window's length, so that a
    window is the first rows of its own block and the last ones of the block
    before.  A row is also sent to the next block, at the time from which on
    windows leave it out; one pass forwards aggregates own rows up to each time,
    one backwards the sent rows from each time on.  Both run on, so dense
    windows cost no more than sparse ones.  Rows without a time see each other.
    """
    size, at = max(window_ns, 1), F.col(time)
    block = at - F.pmod(at, F.lit(size))
    to = lambda own, b, t: F.struct(F.lit(own).alias("own"), b.cast("long").alias("block"), t.cast("long").alias("at"))
    own, sent = to(True, block, at), to(False, block + size, at + window_ns)
    spread = rows.withColumn("__to", F.explode(F.when(at.isNotNull(), F.array(own, sent)).otherwise(F.array(own))))
    parts: dict[str, tuple[str, Column]] = {}
    for name, (kind, value) in aggregates.items():
        if kind == "avg":
            parts[f"__n_{name}"] = "count", value
            value = value.cast("double")
        if kind == "avg" or kind == "sum" and isinstance(rows.select(value).schema[0].dataType, (DoubleType, FloatType)):
            parts |= {f"__{half}_{name}": ("sum", x) for half, x in zip("hl", _halves(value.cast("double")), strict=True)}
        else:
            parts[name] = kind, value
    w = Window.partitionBy(*keys, "__to.block").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = {}, {}
    for name, (kind, value) in parts.items():
        run = _JOINED[kind][0]
        before[f"__b_{name}"] = run(F.when(F.col("__to.own"), value)).over(w.orderBy("__to.at"))
        after[f"__a_{name}"] = run(F.when(~F.col("__to.own"), value)).over(w.orderBy(F.desc("__to.at")))
    spread = spread.withColumns(before | after).where("__to.own")
    whole = {n: _JOINED[kind][1](F.col(f"__b_{n}"), F.col(f"__a_{n}")) for n, (kind, _) in parts.items()}
    total = lambda n: whole[n] if n in whole else whole[f"__h_{n}"] + whole[f"__l_{n}"]
    out = {n: total(n) if kind != "avg" else F.when(whole[f"__n_{n}"] > 0, total(n) / whole[f"__n_{n}"]) for n, (kind, _) in aggregates.items()}
    return spread.withColumns(out).drop("__to", *before, *after)


def bit_rate(rows: DataFrame, keys: list[str], time: str, size: str, windows: dict[str, int]) -> DataFrame:
    """Add bits a second over each named window of whole seconds, in whole numbers."""
    for name, length in windows.items():
        rows = sliding(rows, keys, time, length * 1_000_000_000, {name: ("sum", F.col(size))})
        rows = rows.withColumn(name, F.floor(F.col(name) * 8 / length).cast("long"))
    return rows


def counters(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def active(rows: DataFrame, keys: list[str], time: str, now: int, idle: int = 300 * 1_000_000_000) -> DataFrame:
    """Streams updated within ``idle`` of ``now``: (keys, last_update)."""
    last = rows.where(F.col(time) <= now).groupBy(*keys).agg(F.max(time).alias("last_update"))
    return last.where(F.lit(now) - F.col("last_update") <= idle)


def connected(states: DataFrame, group: str, session: str, time: str, state: str) -> DataFrame:
    """(group, sessions, connected): by each session's latest state; closed ones are gone."""
    last = states.groupBy(group, session).agg(F.max_by(state, time).alias("s")).where("s <> 'closed'")
    return last.groupBy(group).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("s") == "connected").alias("connected"))


def frame_rate(frames: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(count - 1) / (last - first) over distinct times; 0 for one frame or no span."""
    d = frames.select(*keys, time).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("a"), F.max(time).alias("b"))
    span = (F.col("b") - F.col("a")) / F.lit(1e9)
    return d.select(*keys, F.when((F.col("n") > 1) & (span > 0), (F.col("n") - 1) / span).otherwise(0.0).alias("frame_rate"))


def last_window(rows: DataFrame, keys: list[str], time: str, now: int, measures: dict[str, str], window_ns: int = 10 * 1_000_000_000, counts: dict[str, Column] | None = None) -> DataFrame:
    """Least, mean and greatest of measures over the window that ends now, and counts; 0 where there is nothing.

    One row for each key of ``rows``: (keys, name_min, name_avg, name_max ..., counts).
    """
    inside = (F.col(time) <= now) & (F.col(time) > now - window_ns)
    kinds = {"min": F.min, "avg": F.avg, "max": F.max}
    columns = [F.coalesce(f(F.when(inside, F.col(c))), F.lit(0)).cast("double").alias(f"{n}_{k}") for n, c in measures.items() for k, f in kinds.items()]
    return rows.groupBy(*keys).agg(*columns, *[F.count_if(inside & c).alias(n) for n, c in (counts or {}).items()])


#: What each protocol reports beside the rates of its tracks.
BUFFERED, CONNECTED = ("rtp", "whip_input", "whep_input", "hls_input"), ("whip_output",)


def protocol_report(rows: DataFrame, time: str, now: int) -> DataFrame:
    """One nested row for each reference and track: bits a second over a second and a minute, and what its protocol adds.

    ``rows``: ref, protocol, track, size (bytes), buffer (ns, null if it isn't
    measured), connected.  Buffered protocols add a block of the last ten
    seconds, some outputs whether they are connected; the other fields are null.
    """
    second = 1_000_000_000
    bits = lambda n: F.floor(F.coalesce(F.sum(F.when((F.col(time) <= now) & (F.col(time) > now - n * second), F.col("size"))), F.lit(0)) * 8 / n).cast("long")
    keys = ["ref", "protocol", "track"]
    rates = rows.where(F.col(time) <= now).groupBy(*keys).agg(bits(1).alias("bitrate_1_second"), bits(60).alias("bitrate_1_minute"), F.max_by("connected", time).alias("c"), F.count(F.lit(1)).alias("received"))
    recent = last_window(rows, keys, time, now, {"buffer": "buffer"}, counts={"packets": F.lit(True)})
    block = F.struct(F.col("packets").alias("packets_received"), *[F.col(f"buffer_{k}").alias(f"effective_buffer_{k}") for k in ("min", "avg", "max")])
    return rates.join(recent, keys).select(
        *keys, "received", "bitrate_1_second", "bitrate_1_minute", F.when(F.col("protocol").isin(*BUFFERED), block).alias("last_10_seconds"), F.when(F.col("protocol").isin(*CONNECTED), F.col("c")).alias("is_connected")
    )


def snapshot(report: DataFrame) -> DataFrame:
    """The whole of a protocol report as one ordered document a reference: (ref, report) with JSON text."""
    tracks = F.array_sort(F.collect_list(F.struct("track", *[c for c in report.columns if c not in ("ref", "track")])))
    return report.groupBy("ref").agg(F.to_json(F.struct(tracks.alias("tracks"))).alias("report")).orderBy("ref")


def report(rows: DataFrame, keys: list[str], windows: list[DataFrame]) -> DataFrame:
    """One nested row for each key, ordered by key."""
    out = rows
    for w in windows:
        out = out.join(w, keys, "left")
    return out.orderBy(*keys)
