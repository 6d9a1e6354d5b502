"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next one's documents; all but the last keep the columns of
``documents``.

Nulls: a null text is an empty document, which no stage rejects for that; the
mix leaves documents without words out, since there is nothing to take.  Rows
with equal ids are one document for near-duplicates and stay or go together;
null ids are kept.  Repeated rows are scored, mixed and packed each.  Very long
texts are handled whole.  Empty tables give empty tables.  Columns beside those
of ``documents``, whatever their names, are kept by all stages but the last,
which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import dedup, mixing, packing, pii, toxicity
from chronoloom.llm.common import read, written
from chronoloom.llm.queries import tokenizer_path

SEQUENCE_LENGTH = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, held_out=F.lit(False))
    return toxicity.clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    classes = dedup.near_duplicates(docs, shingle_words=5, percent=80)
    gone = classes.where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by the name of its kind."""
    return pii.redact(docs, pii.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated and cut to their target weights."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids (16-bit, little-endian), sequence and place in it."""
    pieces = packing.cut(docs, tokenizer_path(), end_id=0, length=SEQUENCE_LENGTH, width=2, max_pieces=150_000, ranked=True)
    return packing.pack_ranked(pieces, SEQUENCE_LENGTH)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
