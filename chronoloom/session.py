"""What a session needs before Python functions of this package run in its workers."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_import(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed or shipped with ``--py-files``; for
    workers that see the driver's folders its place goes to their search path.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (known, _ROOT) if x)
    return spark


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="chronoloom-")


def shared_dir(spark: SparkSession, prefix: str = "tables") -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all machines see.

    Only a local session may leave that setting out; a folder of this process
    is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        root = _own_folder()
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts lineage in a way that outlives any executor, and computes ``df``
    once however often the result is read.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
