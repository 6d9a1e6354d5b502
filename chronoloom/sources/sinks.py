"""Sinks by name: where streams go, and copies of inputs on their way.

A sink takes a table and options and returns what it wrote to, a path or a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .tables import AlreadyRegistered, NotRegistered

_SINKS: dict[str, Callable[..., object]] = {}


def register(kind: str, writer: Callable[..., object]) -> None:
    if kind in _SINKS:
        raise AlreadyRegistered(kind)
    _SINKS[kind] = writer


def unregister(kind: str) -> None:
    if kind not in _SINKS:
        raise NotRegistered(kind)
    del _SINKS[kind]


def open_sink(kind: str, rows: DataFrame, **options) -> object:
    if kind not in _SINKS:
        raise NotRegistered(kind)
    return _SINKS[kind](rows, **options)


def rescaled(pts: Column, num: int, den: int) -> Column:
    """Nanoseconds in units of num/den seconds, the nearest, halves away from zero."""
    return F.round(pts.cast("decimal(28,0)") * F.lit(den) / F.lit(num * 1_000_000_000), 0).cast("long")


def file(rows: DataFrame, path: str | None = None, num: int = 1, den: int = 90_000, format: str = "parquet") -> str:
    """Packets in order of arrival, with their times also in the file's own units: adds file_pts."""
    path = path or f"{shared_dir(rows.sparkSession)}/file"
    order = [c for c in ("arrival", "pts") if c in rows.columns]
    rows.withColumn("file_pts", rescaled(F.col("pts"), num, den)).sortWithinPartitions(*order).write.format(format).save(path)
    return path


def segmented(rows: DataFrame, path: str | None = None, keep: int | None = None) -> str:
    """A folder for each segment (column ``segment``) of each input; ``keep`` leaves the last ones of an input."""
    path = path or f"{shared_dir(rows.sparkSession)}/segments"
    if keep is not None:
        last = rows.groupBy("input_id").agg(F.max("segment").alias("__last"))
        rows = rows.join(last, "input_id").where(F.col("segment") > F.col("__last") - keep).drop("__last")
    rows.write.partitionBy("input_id", "segment").parquet(path)
    return path


def tapped(rows: DataFrame, offset: int = 0, start_pts: int = 0) -> DataFrame:
    """A copy of an input as a side channel gets it, before anything is dropped: times from the start of the clock on."""
    return rows.withColumn("pts", F.greatest(F.col("pts") + offset - start_pts, F.lit(0).cast("long")))


def tap(rows: DataFrame, path: str | None = None, offset: int = 0, start_pts: int = 0) -> str:
    path = path or f"{shared_dir(rows.sparkSession)}/tap"
    tapped(rows, offset, start_pts).write.parquet(path)
    return path


for _kind, _writer in {"file": file, "segments": segmented, "tap": tap, "none": lambda rows: rows.write.format("noop").mode("overwrite").save()}.items():
    register(_kind, _writer)
