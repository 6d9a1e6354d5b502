"""Token ids in flat unsigned integer files with 64-bit document offsets.

A data set is a folder of shards in ascending document order:

* ``NNNNNN.bin``: the ids of the shard's documents, one after the other,
* ``NNNNNN.idx``: unsigned 64-bit starts of its documents in the shard and the end,
* ``NNNNNN.doc``: signed 64-bit document ids, then one byte each, 1 where the id is null,
* ``manifest.json``: bytes in an id, and for each shard its documents, ids and
  the ids before it, which are prefix sums over the shards.

Documents are dealt out by ranges of ids, as many as their bytes need, and
sorted within; each task writes its shard as a stream and renames it when
whole, so a task that runs again replaces equal files.  The driver gets one row
of counts for each shard.  Reading maps the files into memory, one task a shard.

Nulls: a null text is empty, its document has the end id only; null ids sort
first.  Rows with equal ids are ordered by a hash of the text, equal rows by
their place in the input, so that no id or text keeps rows together in one
shard.  Very long texts are encoded in stretches.  An empty table gives an
empty data set; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_import
from . import files
from .common import lean, shared_dir, tasks_for, text_size
from .shingles import slices
from .tokens import encoder

#: Bytes of text.
SHARD_BYTES = 16 << 20
_BATCH, _BYTES = 128, 4 << 20


def _name(folder: str, shard: int, kind: str) -> str:
    return f"{folder}/{shard:06d}.{kind}"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, width: int = 2) -> str:
    """Encode ``text`` in order of ``doc_id``, append ``end_id`` to each; return the folder."""
    spark = workers_import(docs.sparkSession)
    folder = folder or f"{shared_dir(spark)}/tokens"

    def write(batches):
        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer, width)
        end = np.array(end_id, coder.dtype)
        sizes, ids, null = [], [], []

        def stream(f):
            for batch in batches:
                null.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
                ids.append(batch.column(0).fill_null(0).to_numpy())
                for lo, hi in slices(batch.column(1), _BYTES):
                    found, at = coder.encode(batch.column(1).slice(lo, hi - lo))
                    f.write(np.insert(found, at[1:], end).tobytes())
                    sizes.append(np.diff(at) + 1)

        files.put(_name(folder, shard, "bin"), stream)
        offsets = np.cumsum(np.concatenate([[0], *sizes]), dtype="<u8")
        files.put(_name(folder, shard, "idx"), lambda f: f.write(offsets.tobytes()))
        files.put(_name(folder, shard, "doc"), lambda f: f.write(b"".join(x.astype(k).tobytes() for k, part in (("<i8", ids), ("u1", null)) for x in part)))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])]})

    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place")]
    rows = docs.select(*order, text.alias("text"))
    shards = tasks_for(text_size(docs), SHARD_BYTES)
    rows = rows.repartitionByRange(shards, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place").select("doc_id", "text")
    counts = sorted(tuple(r) for r in rows.mapInArrow(lean(write), "shard long, n_docs long, n_tokens long").collect())
    manifest, before = [], 0
    for shard, n_docs, n_tokens in counts:
        manifest.append({"shard": shard, "n_docs": n_docs, "n_tokens": n_tokens, "before": before})
        before += n_tokens
    files.put(f"{folder}/manifest.json", lambda f: f.write(json.dumps({"width": width, "shards": manifest}).encode()))
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a data set; ids as little-endian unsigned 32-bit numbers."""
    workers_import(spark)
    width = {1: "u1", 2: "<u2", 4: "<u4"}
    manifest = json.loads(bytes(files.mapped(f"{folder}/manifest.json", "u1")))
    shards, dtype = [s for s in manifest["shards"] if s["n_docs"]], width[manifest["width"]]
    by_number = {s["shard"]: s for s in shards}

    def read(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n, before = by_number[shard]["n_docs"], by_number[shard]["before"]
                ids, at = files.mapped(_name(folder, shard, "bin"), dtype), files.mapped(_name(folder, shard, "idx"), "<u8")
                raw = files.mapped(_name(folder, shard, "doc"), "u1")
                docs, null = raw[: 8 * n].view("<i8"), raw[8 * n :].astype(bool)
                for lo in range(0, n, _BATCH):
                    hi = min(n, lo + _BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(docs[lo:hi], mask=null[lo:hi], type=pa.int64()),
                            pa.array((at[lo:hi] + before).astype("int64")),
                            pa.array((at[lo + 1 : hi + 1] - at[lo:hi]).astype("int64")),
                            pa.array([ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(lo, hi)], type=pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame([(s["shard"],) for s in shards], "shard int").repartition(len(shards))
    return numbers.mapInArrow(read, schema)
