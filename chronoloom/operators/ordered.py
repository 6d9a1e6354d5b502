"""Ordered operators that don't gather a whole stream in one task.

A window over one input's rows alone puts that input into one task, however
long it is.  These helpers cut each stream into buckets of time, run the window
inside buckets, and carry what crosses a bucket's edge through a table with one
row for each bucket.  ``bucket`` names a column that rises with the order.  A
key's buckets are carried in one task: with some thousand rows to a bucket that
holds up to about 10**9 rows a key, beyond which buckets must be longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def _within(keys: Names, bucket: str, order: list) -> Window:
    return Window.partitionBy(*keys, bucket).orderBy(*order)


def _join_carry(df: DataFrame, carry: DataFrame, keys: Names, bucket: str) -> DataFrame:
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, bucket]]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    kept = [c for c in carry.columns if c not in (*keys, bucket)]
    return df.alias("l").join(carry.alias("r"), condition, "left").select("l.*", *[f"r.{c}" for c in kept])


def with_lag(df: DataFrame, keys: Names, bucket: str, order: Names, lags: dict[str, str]) -> DataFrame:
    """Add, for each ``new: column``, the column's value in the row before; null in a stream's first row."""
    edge = df.groupBy(*keys, bucket).agg(F.max(F.struct(*order, *[F.col(c).alias(f"__v_{n}") for n, c in lags.items()])).alias("__last"))
    carry = edge.select(*keys, bucket, F.lag("__last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("__before"))
    out = _join_carry(df, carry, keys, bucket)
    w = _within(keys, bucket, order)
    first = F.row_number().over(w) == 1
    for name, column in lags.items():
        out = out.withColumn(name, F.when(first, F.col("__before")[f"__v_{name}"]).otherwise(F.lag(column).over(w)))
    return out.drop("__before")


def with_running_sum(df: DataFrame, keys: Names, bucket: str, order: Names, sums: dict[str, Column]) -> DataFrame:
    """Add, for each ``new: expression``, its sum over all rows up to this one."""
    total = df.groupBy(*keys, bucket).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select(*keys, bucket, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums])
    out = _join_carry(df, carry, keys, bucket)
    w = _within(keys, bucket, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, e in sums.items():
        out = out.withColumn(name, F.col(f"__c_{name}") + F.coalesce(F.sum(e).over(w), F.lit(0)))
    return out.drop(*[f"__c_{n}" for n in sums])


def with_running_max(df: DataFrame, keys: Names, bucket: str, order: list, tops: dict[str, Column]) -> DataFrame:
    """Add, for each ``new: expression``, its greatest value of all rows before this one."""
    top = df.groupBy(*keys, bucket).agg(*[F.max(e).alias(f"__m_{n}") for n, e in tops.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = top.select(*keys, bucket, *[F.max(f"__m_{n}").over(before).alias(f"__cm_{n}") for n in tops])
    w = _within(keys, bucket, order).rowsBetween(Window.unboundedPreceding, -1)
    out = _join_carry(df, carry, keys, bucket)
    for name, e in tops.items():
        out = out.withColumn(name, F.greatest(F.col(f"__cm_{name}"), F.max(e).over(w)))
    return out.drop(*[f"__cm_{n}" for n in tops])


def as_of(probes: DataFrame, builds: DataFrame, keys: Names, probe_time: str, build_time: str, values: Names, bucket_ns: int, tie: str | None = None, strict: bool = False) -> DataFrame:
    """For each probe the newest build row of its keys at or before it (``strict``: before it).

    Adds ``build_time`` and ``values`` to the probes, null where there is none.
    Of builds at the same time the greatest ``tie`` wins.  Both sides are dealt
    out by keys and time buckets; a bucket starts with the newest row of the
    buckets before it.
    """
    bucket = lambda t: F.floor(F.col(t) / F.lit(bucket_ns)).cast("long")
    packed = F.struct(F.col(build_time).alias("t"), (F.col(tie) if tie else F.lit(0)).alias("tie"), *values)
    side = builds.where(F.col(build_time).isNotNull()).select(*keys, bucket(build_time).alias("__b"), packed.alias("__row"))
    newest = side.groupBy(*keys, "__b").agg(F.max("__row").alias("__row"))
    ask = probes.select(*keys, bucket(probe_time).alias("__b")).distinct()
    # the newest row before each bucket that is asked for
    both = newest.select(*keys, "__b", "__row").unionByName(ask.withColumn("__row", F.lit(None).cast(side.schema["__row"].dataType)))
    steps = both.groupBy(*keys, "__b").agg(F.max("__row").alias("__row"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.select(*keys, "__b", F.last("__row", ignorenulls=True).over(before).alias("__row")).where("__row is not null")
    # builds of a bucket come before or after a probe of the same time
    rank_build, rank_probe = (1, 0) if strict else (0, 1)
    payload = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    empty = F.lit(None).cast(probes.select(payload.alias("x")).schema["x"].dataType)
    rows = (
        side.select(*keys, "__b", F.col("__row.t").alias("__t"), F.lit(rank_build).alias("__rank"), "__row", empty.alias("__p"))
        .unionByName(carry.select(*keys, "__b", F.col("__row.t").alias("__t"), F.lit(rank_build).alias("__rank"), "__row", empty.alias("__p")))
        .unionByName(probes.select(*keys, bucket(probe_time).alias("__b"), F.col(probe_time).alias("__t"), F.lit(rank_probe).alias("__rank"), F.lit(None).cast(side.schema["__row"].dataType).alias("__row"), payload.alias("__p")))
    )
    w = Window.partitionBy(*keys, "__b").orderBy("__t", "__rank", "__row.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__row", F.last("__row", ignorenulls=True).over(w)).where("__p is not null")
    return found.select("__p.*", F.col("__row.t").alias(build_time), *[F.col(f"__row.{v}").alias(v) for v in values])
