"""Mixing sampled streams: weighted sums, limits, and the gain that follows peaks.

Samples come as rows (input_id, chunk_ix, ix, l, r), one for each sample, or as
arrays of them for one chunk.  Sums are plain aggregates; only the gain needs
the chunks of one output in order, and folds over one number for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import workers_import
from .ordered import with_lag


@dataclass(frozen=True)
class Gain:
    """Peaks above ``down`` times the gain lower it, peaks below ``up`` raise it, by these steps."""

    down: float = 1.0
    up: float = 0.7
    down_step: float = 0.02
    up_step: float = 0.01


def weighted_sum(samples: DataFrame, mix: DataFrame, bits: int = 40) -> DataFrame:
    """(output_id, chunk_ix, ix, l, r): each output's inputs times their volumes, summed.

    ``mix``: (output_id, input_id, volume); an input listed twice counts twice.
    Sums are taken in fixed point, so that they don't depend on the order.
    """
    scale = float(1 << bits)
    fixed = lambda c: F.sum(F.round(F.col(c) * F.col("volume") * scale).cast("decimal(38,0)"))
    joined = samples.join(mix, "input_id")
    return joined.groupBy("output_id", "chunk_ix", "ix").agg(*[(fixed(c).cast("double") / scale).alias(c) for c in ("l", "r")])


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def peaks(mixed: DataFrame) -> DataFrame:
    return mixed.groupBy("output_id", "chunk_ix").agg(F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"), F.count(F.lit(1)).alias("n"))


def gains(chunk_peaks: DataFrame, gain: Gain = Gain(), start: float = 1.0) -> DataFrame:
    """(output_id, chunk_ix, old_gain, new_gain), an ordered fold over chunks.

    The gain depends on all chunks before, without a closed form; rows stream
    through in order, so memory doesn't grow with a stream's length.
    """
    workers_import(chunk_peaks.sparkSession)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        output, factor = None, start
        for rows in parts:
            old, new = [], []
            for o, peak in zip(rows["output_id"], rows["peak"], strict=True):
                if o != output:
                    output, factor = o, start
                old.append(factor)
                if peak * factor > gain.down:
                    factor = max(factor - gain.down_step, 0.0)
                elif peak * factor < gain.up:
                    factor = min(factor + gain.up_step, 1.0)
                new.append(factor)
            yield pd.DataFrame({"output_id": rows["output_id"], "chunk_ix": rows["chunk_ix"], "old_gain": old, "new_gain": new})

    rows = chunk_peaks.select("output_id", "chunk_ix", "peak").repartition("output_id").sortWithinPartitions("output_id", "chunk_ix")
    return rows.mapInPandas(fold, "output_id string, chunk_ix long, old_gain double, new_gain double")


def scaled(mixed: DataFrame, gain: Gain = Gain()) -> DataFrame:
    """The mix times its gain, which moves in a line inside a chunk, clipped."""
    tops = peaks(mixed)
    factors = gains(tops, gain).join(tops.select("output_id", "chunk_ix", "n"), ["output_id", "chunk_ix"])
    out = mixed.join(factors, ["output_id", "chunk_ix"])
    f = F.col("old_gain") + (F.col("new_gain") - F.col("old_gain")) * F.col("ix") / F.col("n")
    return out.select("output_id", "chunk_ix", "ix", *[clipped(F.col(c) * f).alias(c) for c in ("l", "r")])


def gap_zeros(batches: DataFrame, keys: list[str], bucket: str, rate: int) -> DataFrame:
    """How many zero samples stand before each batch: adds zeros, from the gap since the last end."""
    out = with_lag(batches, keys, bucket, ["start_pts", "end_pts"], {"__end": "end_pts"})
    gap = F.greatest(F.coalesce(F.col("start_pts") - F.col("__end"), F.lit(0)), F.lit(0))
    return out.withColumn("zeros", F.floor(gap / F.lit(1e9) * F.lit(float(rate))).cast("long")).drop("__end")


def merged_volumes(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Several references to an input as one, with volumes up to one together."""
    return refs.groupBy(*keys).agg(F.least(F.sum("volume"), F.lit(1.0)).alias("volume"))


def mono(left: Column, right: Column) -> Column:
    return (left + right) / 2.0


#: Fixed values (ns): how far behind zeros are put in, the dead band, how far ahead samples are dropped; the greatest change of rate.
STRETCH_LIMIT, SHIFT_LIMIT, SQUASH_LIMIT, MOST_STRETCH = 40_000_000, 2_000_000, 500_000_000, 0.041


def drift_action(input_pts: Column, wanted_pts: Column) -> Column:
    """Struct (action, ratio) for input that starts later or earlier than wanted.

    Ratios reach their limit halfway to the point where samples are put in or dropped.
    """
    drift = input_pts - wanted_pts
    share = lambda limit: F.least(F.lit(2.0) * MOST_STRETCH * F.abs(drift) / float(limit), F.lit(MOST_STRETCH))
    action = (
        F.when(drift > STRETCH_LIMIT, "gap_fill").when(drift > SHIFT_LIMIT, "stretch").when(drift > -SHIFT_LIMIT, "on_time").when(drift > -SQUASH_LIMIT, "squash").otherwise("drop")
    )
    ratio = F.when(action == "stretch", 1 + share(STRETCH_LIMIT)).when(action == "squash", 1 - share(SQUASH_LIMIT)).otherwise(1.0)
    return F.struct(action.alias("action"), ratio.alias("ratio"))


def accepted(batches: DataFrame, keys: list[str], overlap: int = 80_000_000) -> DataFrame:
    """Batches that don't start more than ``overlap`` before the end of the last accepted one.

    Whether one is accepted depends on those accepted before: a fold in order,
    streaming, with one number of state.
    """
    workers_import(batches.sparkSession)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, end = None, None
        for rows in parts:
            keep = []
            for own, a, b in zip(rows[keys].itertuples(index=False, name=None), rows["start_pts"], rows["end_pts"], strict=True):
                if own != stream:
                    stream, end = own, None
                ok = end is None or a >= end - overlap
                end = b if ok else end
                keep.append(ok)
            yield rows[keep]

    return batches.repartition(*keys).sortWithinPartitions(*keys, "start_pts", "end_pts").mapInPandas(fold, batches.schema)


def output_times(samples: DataFrame, rate: int) -> DataFrame:
    """Start of each produced batch from the samples before it: adds pts. ``samples``: (output_id, batch_ix, first_pts, n)."""
    w = Window.partitionBy("output_id").orderBy("batch_ix").rowsBetween(Window.unboundedPreceding, -1)
    made = F.coalesce(F.sum("n").over(w), F.lit(0))
    return samples.withColumn("pts", F.first("first_pts").over(Window.partitionBy("output_id").orderBy("batch_ix")) + F.floor(made * F.lit(1_000_000_000) / rate).cast("long"))


def mean_squared_error(a: Column, b: Column) -> Column:
    """Over two arrays of numbers; 10000 where their lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), 10_000.0).when(F.size(a) == 0, 0.0).otherwise(total / F.size(a))
