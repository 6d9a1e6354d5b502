"""Helpers that all operators of this package share."""

from __future__ import annotations

import contextlib
import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = bytes.maketrans(ASCII_UPPER.encode(), ASCII_UPPER.lower().encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Without it the optimizer may copy a costly expression into every place
    that reads it, even into a lambda that runs once for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def by_place(docs: DataFrame, *first: str) -> DataFrame:
    """The columns named ``first``, then all columns, under names of ours that none of theirs can meet."""
    rows = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    return rows.select(*[F.col(f"__c{docs.columns.index(c)}").alias(f"__f{i}") for i, c in enumerate(first)], *rows.columns)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all machines see."""
    return session.shared_dir(spark, "llm")


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts lineage in a way that outlives any executor, and computes ``df``
    once however often the result is read.  What is needed no more goes to
    :func:`discard`.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path.rpartition("/")[0]
    return back


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables; nothing that is still to be computed may read them."""
    for df in tables:
        if df is not None:
            drop_shared(df.sparkSession, df.written_to)


def release() -> None:
    """Give a worker's free memory back to the system: workers stay, and the next stage needs it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over a task's batches that releases memory when they are through."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def drop_shared(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by :func:`shared_dir`, through Hadoop's file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts, and 16 for each row."""
    return docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16).cast("long"))).first()[0] or 0


def tasks_for(size: int, size_per_task: int, least: int = 1) -> int:
    """How many tasks give each about ``size_per_task`` of what ``size`` counts; grows with the data."""
    return max(least, -(-size // size_per_task))
