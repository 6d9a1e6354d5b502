"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key ``-ln(u) / w``, where ``u`` is a uniform number
hashed from its id and text and ``w`` its quality weight; ascending keys are a
weighted random order without replacement.  A source whose target is ``e`` full
passes and a rest gives every document ``e`` times (complete epochs come first)
and the rest goes to documents in the order of their keys, up to the budget;
the document at the edge is cut to the words that are left.

Only one narrow table of (id, source, size, key) is computed from the texts.
Budgets are found from sums over (source, key bucket) and then over the groups
of equal rows in the one bucket of each source where its budget ends, so that
no task sees a whole source.  What comes out is one cut for each source: rows
whose (key, id, size) is below it are taken, rows above it aren't, and the row
at the cut is taken in part.  Any row can be held against it, so the texts
themselves aren't shuffled to be mixed.  Rows that are equal in all three stand
at the same place; where the cut falls between such rows they are numbered by
partition and place in it, with prefix sums over the partitions.

Nulls: a null text has size 0, a null source is a source of its own, sorted
last, a null id is kept as null.  Ties in the key fall back to id and size;
repeated rows are taken each.  Very long texts are documents like others.
Empty tables give empty results; other columns are ignored, or kept by
:func:`mixed_documents`, whatever their names.  Sources are sorted in one task,
a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, discard, let, written

#: Documents in a key bucket, on average.
BUCKET_ROWS = 2000


#: From a text and its words, how good a document is.
Weight = Callable[[Column, Column], Column]


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.2 and 1: 1 where words have the usual five characters on average."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.2), F.exp(-F.abs(mean - 6.0) / 6.0))


def _keyed(doc_id: Column, text: Column, seed: int, weight: Weight = quality_weight) -> Column:
    """(size, key) of a document."""
    # 52 bits of the digest, so that the uniform number is exact
    drawn = lambda t: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), t).cast("binary"))
    uniform = lambda t: (F.conv(F.substring(drawn(t), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return let(
        F.struct(F.coalesce(text, F.lit("")).alias("t"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("n")),
        lambda x: F.struct(x["n"].alias("size"), (-F.log(uniform(x["t"])) / weight(x["t"], x["n"])).alias("key")),
    )


def documents_with_keys(docs: DataFrame, seed: int = 17, weight: Weight = quality_weight) -> DataFrame:
    """(doc_id, source, size, key): one pass over the texts."""
    return docs.select("doc_id", "source", _keyed(F.col("doc_id"), F.col("text"), seed, weight).alias("__k")).select("doc_id", "source", "__k.*")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Targets of all sources: (source, source_size, n_docs, target).

    ``sizes`` has (source, source_size, n_docs).  Weights go to the sources in
    code point order, null last, and repeat.  A target is the smaller of
    ``most * source_size`` and ``level * weight``, with the one level at which
    targets sum to all words; this is where repeated resharing of the excess
    ends.  In order of the cap per weight the capped sources are a prefix, so
    running sums find it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy()
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ranked.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("left_size", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("own_level", F.col("left_size") / F.col("left_weight"))
        .withColumn("rank", F.row_number().over(ranked))
        .withColumn("free", F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.struct("rank", "own_level")))
        .withColumn("level", F.min("free").over(every)["own_level"])
        # no level: even all caps together are below the words to share
        .select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("key", "doc_id", "size")])


def cuts(keyed: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row for each source: target, epochs, and the place in its order where the rest of its budget ends.

    (__source, source_size, target, epochs, cut, rest, ties): the first of
    ``ties`` equal rows at ``cut`` have ``rest`` words left between them; a
    null cut takes nothing more.
    """
    sizes = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = (
        source_targets(sizes, weights, most)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0))
        .withColumn("budget", F.greatest(F.lit(0), F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
        .withColumn("n_buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)))
        .withColumnRenamed("source", "__source")
    )
    plan = written(plan, "plan")
    # One row per source: joined by value, so Spark may send it to all tasks if it is small and shuffles it if not.
    rows = keyed.join(plan.where("budget > 0"), _same("source", "__source"))
    spread = (F.lit(1.0) - F.exp(-F.col("key") / F.lit(math.sqrt(2)))) * F.col("n_buckets")
    rows = rows.withColumn("bucket", F.least(F.floor(spread), F.col("n_buckets") - 1))
    upto = lambda order: Window.partitionBy("__source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__source", "bucket").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    edges = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(upto(["bucket"])), F.lit(0)))
        .where((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
        .select(F.col("__source").alias("__edge_source"), F.col("bucket").alias("edge"), (F.col("budget") - F.col("before")).alias("left"))
    )
    at_edge = rows.join(edges, F.col("__source").eqNullSafe(F.col("__edge_source")) & (F.col("bucket") == F.col("edge")))
    groups = at_edge.groupBy("__source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("ties"), F.first("left").alias("left"))
    groups = groups.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("ties")).over(upto(["key", "doc_id", "size"])), F.lit(0)))
    found = groups.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("size") * F.col("ties") >= F.col("left")))
    found = found.select(F.col("__source").alias("__cut_source"), _place().alias("cut"), (F.col("left") - F.col("before")).alias("rest"), "ties")
    out = written(plan.join(found, _same("__source", "__cut_source"), "left").select("__source", "source_size", "target", "epochs", "cut", "rest", "ties"), "cuts")
    discard(plan)
    return out


def _taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Add source_size, target and taken to rows that have source, doc_id, size and key."""
    rows = rows.join(cut, _same("source", "__source")).drop("__source")
    base, own = F.col("epochs") * F.col("size"), _place()
    below = F.coalesce(own < F.col("cut"), F.lit(False))
    here = F.coalesce(own == F.col("cut"), F.lit(False))

    def taken(nth: Column) -> Column:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - nth * F.col("size")))
        return (base + F.when(below, F.col("size")).when(here, part).otherwise(0)).cast("long")

    if cut.where("ties > 1").isEmpty():
        return rows.withColumn("taken", taken(F.lit(0))).drop("epochs", "cut", "rest", "ties")
    # few sources, if any, have their cut between equal rows: only these rows are numbered
    mono = F.monotonically_increasing_id()
    tied = here & (F.col("ties") > 1)
    at = rows.where(tied).withColumn("__split", F.shiftright(mono, 33))
    before = at.groupBy("source", "__split").agg(F.count(F.lit(1)).alias("__n"))
    before = before.select(F.col("source").alias("__s"), F.col("__split").alias("__p"), F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = at.join(before, _same("source", "__s") & (F.col("__split") == F.col("__p")))
    within = F.row_number().over(Window.partitionBy("source", "__split").orderBy("doc_id"))
    numbered = numbered.withColumn("taken", taken(F.col("__before") + within - 1)).drop("__split", "__s", "__p", "__before")
    return rows.where(~tied).withColumn("taken", taken(F.lit(0))).unionByName(numbered).drop("epochs", "cut", "rest", "ties")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17, weight: Weight = quality_weight) -> DataFrame:
    """Return (doc_id, size, source_size, target, taken) for each row of ``docs``.

    ``taken`` is the number of words that the mix takes of the document,
    repeats counted; ``docs`` needs doc_id, text and source, other columns are
    ignored.  ``weight`` makes a positive quality weight from text and size.
    """
    keyed = written(documents_with_keys(docs, seed, weight), "keys")
    return _taken(keyed, cuts(keyed, weights, most)).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("size", "source_size")], F.col("target").cast("double").alias("target"), "taken"
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17, weight: Weight = quality_weight) -> DataFrame:
    """The mix itself: each document repeated whole, then its cut rest, with the columns of ``docs``.

    A cut text ends with the last word that is taken, its white space as it was.
    """
    keyed = written(documents_with_keys(docs, seed, weight), "keys")
    # columns by place, so that none of their names meets one of ours
    at = {c: f"doc_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*at.values())
    rows = rows.withColumn("__k", _keyed(F.col(at["doc_id"]), F.col(at["text"]), seed, weight)).select(*at.values(), F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), "__k.*")
    cut = cuts(keyed, weights, most)
    discard(keyed)
    rows = _taken(rows, cut).where("taken > 0")
    text = F.col(at["text"])
    times = F.floor(F.col("taken") / F.col("size"))
    rest = F.col("taken") - times * F.col("size")
    copies = F.concat(F.array_repeat(F.col("size"), times.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(*at.values(), "size", F.explode(copies).alias("words"))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACE + "*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn(at["text"], F.when(F.col("words") == F.col("size"), text).otherwise(head))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(text).cast("long"))
    return rows.select(*at.values()).toDF(*at)
