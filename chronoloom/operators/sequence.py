"""Numbered packets: unwrapping counters, display order, units.  Order, loss and release: :mod:`jitter`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import with_lag, with_running_max, with_running_sum


def unwrap(packets: DataFrame, keys: list[str], bucket: str, order: list[str], counters: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Add full numbers of counters that wrap: ``name: (counter, bits, turns at the start)``, all in one pass.

    A step of half the range or more is a turn, forward if the number fell and
    back if it rose; turns never go below zero.  A running sum that is held at
    zero equals the plain sum less its least value so far, which keeps this a
    sum and a maximum instead of a fold.
    """
    out = with_lag(packets, keys, bucket, order, {f"__prev_{n}": c for n, (c, _, _) in counters.items()})
    for name, (counter, bits, _) in counters.items():
        last, half = F.col(f"__prev_{name}"), ((1 << bits) - 1) // 2
        turn = F.when(F.abs(last - F.col(counter)) >= half, F.when(last > F.col(counter), 1).otherwise(-1)).otherwise(0)
        out = out.withColumn(f"__turn_{name}", F.coalesce(turn, F.lit(0)).cast("long"))
    out = with_running_sum(out, keys, bucket, order, {f"__turns_{n}": F.col(f"__turn_{n}") for n in counters})
    out = out.withColumns({f"__turns_{n}": F.col(f"__turns_{n}") + start for n, (_, _, start) in counters.items()})
    out = with_running_max(out, keys, bucket, order, {f"__under_{n}": -F.col(f"__turns_{n}") for n in counters})
    for name, (counter, bits, _) in counters.items():
        turns = F.col(f"__turns_{name}")
        under = F.greatest(F.lit(0).cast("long"), F.coalesce(f"__under_{name}", F.lit(0)), -turns)
        out = out.withColumn(name, (turns + under) * F.lit(1 << bits) + F.col(counter))
    return out.drop(*[f"__{x}_{n}" for n in counters for x in ("prev", "turn", "turns", "under")])


def picture_order(frames: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Frames in display order: adds group (counts IDR frames) and display_ix, the place in its group.

    Groups end at the next IDR frame, so a window over one is bounded by its length.
    """
    out = with_running_sum(frames.withColumn("__idr", F.col("is_idr").cast("long")), keys, bucket, order, {"group": F.col("__idr")}).drop("__idr")
    return out.withColumn("display_ix", F.row_number().over(Window.partitionBy(*keys, "group").orderBy("poc", *order)).cast("long"))


def payload_groups(packets: DataFrame, keys: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Units of packets up to one with the marker: (keys, unit, n, payload)."""
    out = with_running_sum(packets.withColumn("__m", F.col("marker").cast("long")), keys, bucket, order, {"__after": F.col("__m")})
    out = out.withColumn("unit", F.col("__after") - F.col("__m"))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col("payload").alias("__p"))))
    return out.groupBy(*keys, "unit").agg(F.count(F.lit(1)).alias("n"), parts.alias("__parts")).select(*keys, "unit", "n", F.array_join(F.col("__parts.__p"), "").alias("payload"))


def from_fixed_point(ntp: Column) -> Column:
    """Seconds of a 64-bit time with 32 fraction bits."""
    return ntp.cast("decimal(20,0)") / F.lit(1 << 32)


def to_fixed_point(seconds: Column) -> Column:
    return F.round(seconds.cast("decimal(20,9)") * F.lit(1 << 32)).cast("decimal(20,0)")
