"""Groups of documents with similar shingle sets, from banded signatures.

1. One pass over the texts gives each document the size and a 128-bit digest of
   its shingle set and its bands, each of which is four 16-bit numbers of the
   signature.  Documents with equal sets are one class from here on.
2. Classes that share a band are in a bucket.  Buckets of one are dropped by
   counting before anything else is shuffled; large ones are cut into blocks of
   about ``BLOCK`` members, and whatever is joined to a bucket's members later
   is joined by bucket and block, so that no bucket meets in one task.
3. Candidates are star-shaped: each member of a bucket with the one of least
   priority, so a bucket of n gives n - 1 pairs, not n * n / 2.  All bands use
   the same priorities, so that most of their pairs are the same.
4. Pairs whose sizes allow it are verified on whole sets, and components found
   by alternating large-star and small-star steps.
5. Buckets that still hold more than one component get further stars, now
   around the members that agree most with all others: in a group of edited
   copies that is the text they come from.  What is left after these is compared
   in full, but only between components: members meet in blocks of about
   ``BLOCK``, a block against a block, each pair in the first band it shares,
   and a meeting returns no more links than join its components.  So no link between different texts that share a band is
   lost, and no pair inside a component is formed.

Everything but the loops' counts stays on the executors; tables between steps
are written to the shared folder.

Nulls: a null or empty text has an empty set and is linked with nothing; rows
with a null id get a null component.  Rows with equal ids are one document that
is linked if any of its texts is; repeated rows are each returned.  Ties of
priority fall to the lower id.  Very long texts are read whole, their sets have
to fit into a task.  Empty tables give empty results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import workers_import
from .common import discard, lean, release, tasks_for, written
from .shingles import digest, sets, slices

#: Members in a block, and shingles of all of them: what a task holds.
BLOCK, BLOCK_SHINGLES = 512, 500_000
#: Tasks over which a bucket's members are dealt until its blocks are known.
_SALTS = 8


def profiles(docs: DataFrame, signatures, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) of each document; null digest and no bands for an empty set."""
    workers_import(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1)
                found = sets(texts, k)
                bands = signatures(texts, k).astype("<u2").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in found], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in found], pa.binary()),
                        pa.array([b if len(s) else [] for b, s in zip(bands, found, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, bands array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, shingles): the sets of those documents whose ids are in ``wanted`` (id)."""
    workers_import(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found = sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["id", "shingles"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi")
    return rows.mapInArrow(lean(run), "id long, shingles array<long>")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge (a, b) can reach."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("w")).where("u > w").select("u", "v").distinct()
        large = written(large, "large")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(before, large)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")))
    out = written(ends.distinct(), "components")
    discard(edges)
    return out


def _each_block(buckets: DataFrame) -> DataFrame:
    """Rows of buckets (key, blocks, ...) once for each of their blocks: adds block."""
    return buckets.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _star(members: DataFrame) -> DataFrame:
    """(a, b), a < b: every member of a bucket with the one of least priority."""
    order = F.xxhash64("id")
    centre = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id"))).alias("c"), F.first("blocks").alias("blocks"))
    pairs = members.join(_each_block(centre), ["key", "block"]).select("id", F.col("c.id").alias("other")).where("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _central(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a < b: every member of a bucket with its most central one, where their components differ.

    The centre is the member whose signature agrees most with the most frequent
    number in each place: in a group of edited copies, the text they were made
    from.  Large buckets find theirs in blocks first.
    """
    rows = members.join(classes.select("id", "bands"), "id")

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        sign = np.sort(np.stack(rows["bands"].to_numpy()).astype("<i8").view("<u2"), axis=0)
        raw = np.stack(rows["bands"].to_numpy()).astype("<i8").view("<u2")
        n, places = sign.shape
        # the most frequent number of each column: the longest run once sorted
        new = np.ones((n, places), bool)
        new[1:] = sign[1:] != sign[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n)[:, None], 0), axis=0)
        best = (np.arange(n)[:, None] - start).argmax(axis=0)
        agree = (raw == sign[best, np.arange(places)]).sum(axis=1)
        i = int(agree.argmax())
        return pd.DataFrame({"key": [rows["key"].iat[0]], "blocks": [rows["blocks"].iat[0]], "other": [rows["id"].iat[i]], "agree": [int(agree[i])], "c": [rows["component"].iat[i]]})

    # tasks of few rows, since each costs more than it reads
    rows = rows.repartition(tasks_for(members.count(), 4 * BLOCK), "key", "block")
    found = rows.groupBy("key", "block").applyInPandas(centre, "key long, blocks int, other long, agree long, c long")
    centres = found.groupBy("key").agg(F.max(F.struct("agree", "other", "c")).alias("m"), F.first("blocks").alias("blocks")).select("key", "blocks", "m.other", "m.c")
    pairs = members.join(_each_block(centres), ["key", "block"]).where("component <> c")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _across(members: DataFrame, classes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: links between components of a bucket, enough of them to join what belongs together.

    ``members``: key, band, id, blocks, block, component.  Blocks meet blocks; in each meeting
    pairs of different components that share no earlier band are compared on
    their whole sets, as the caller's check does.  Two components are taken as
    one after their first link, so a meeting returns fewer pairs than it has
    members.
    """
    rows = members.join(classes, "id").join(known, "id")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    columns = ["key", "band", "id", "component", "block", "bands", "shingles"]
    rows = rows.select(*columns, F.explode(meets).alias("m")).select(*columns, "m.i", "m.j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        same, number = rows["i"].iat[0] == rows["j"].iat[0], rows["band"].iat[0]
        left, right = (np.flatnonzero((rows["block"] == rows[c].iat[0]).to_numpy()) for c in ("i", "j"))
        bands, ids, group = np.stack(rows["bands"].to_numpy()).astype("<i8"), rows["id"].to_numpy(), rows["component"].to_numpy().copy()
        sets_of = [np.unique(x) for x in rows["shingles"]]
        size = np.array([len(x) for x in sets_of])
        place = np.unique(np.concatenate(sets_of), return_inverse=True)[1]
        own = np.split(place, np.cumsum(size)[:-1])
        marked = np.zeros(int(place.max()) + 1, bool)
        out: list[tuple[int, int]] = []
        for n, x in enumerate(left):
            other = right[n + 1 :] if same else right
            other = other[group[other] != group[x]]
            other = other[np.minimum(size[other], size[x]) * 100 >= percent * np.maximum(size[other], size[x])]
            if len(other):
                other = other[(bands[other] == bands[x]).argmax(axis=1) == number]
            if not len(other):
                continue
            marked[own[x]] = True
            both = np.add.reduceat(marked[np.concatenate([own[y] for y in other])], np.cumsum(size[other]) - size[other], dtype=np.int64)
            marked[own[x]] = False
            for y in other[100 * both >= percent * (size[x] + size[other] - both)]:
                if group[x] != group[y]:
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    group[group == group[y]] = group[x]
        if len(rows) > BLOCK // 2:
            release()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def link(docs: DataFrame, signatures, k: int, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked where ``100 * |intersection| >= percent * |union|``.
    ``signatures(texts, k)`` returns rows of 16-bit numbers, a multiple of four.
    """
    rows = written(profiles(docs, signatures, k), "profiles")
    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")
    # Equal ids with different texts: one document, whose classes are joined by its id.
    dealt = classes.select("id", "n_shingles", F.posexplode("bands").alias("band", "value"))
    dealt = dealt.select(F.xxhash64("band", "value").alias("key"), "band", "id", "n_shingles", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt"))
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), need.alias("blocks")).where("n > 1")
    shared = shared.select("key", "blocks", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = written(dealt.join(shared, ["key", "salt"]).select("key", "band", "id", "blocks", block.alias("block")).distinct(), "members")
    wanted = written(members.select("id").distinct(), "wanted")
    found = written(whole_sets(docs, wanted, k), "sets")
    known = written(found.repartition("id"), "sets_by_id")
    discard(found)
    sizes = classes.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("n_shingles").alias("most"), F.min("n_shingles").alias("fewest"))

    def verified(pairs: DataFrame) -> DataFrame:
        may = pairs.join(sizes.toDF("a", "a_most", "a_fewest"), "a").join(sizes.toDF("b", "b_most", "b_fewest"), "b")
        may = may.where((F.least("a_most", "b_most") * 100 >= percent * F.greatest("a_fewest", "b_fewest")))
        full = may.select("a", "b").join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
        both = F.size(F.array_intersect("x", "y"))
        return full.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct()

    def several(labels: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, with these."""
        own = members.join(labels, "id", "left").select("key", "band", "id", "blocks", "block", F.coalesce("component", "id").alias("component"))
        mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.first("blocks").alias("blocks")).where("lo <> hi and n > 2")
        return written(own.join(_each_block(mixed.select("key", "blocks")), ["key", "block"]), "mixed")

    tested = links = labels = None
    left, used = members, [members, wanted, known]
    for turn in range(3):
        if turn == 0:
            pairs = _star(left)
        elif turn == 1:
            pairs = _central(left, classes)
        else:
            pairs = _across(left, classes.select("id", "bands"), known, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(verified(pairs), "links")
        used += [pairs, found]
        tested = pairs if tested is None else tested.unionByName(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            old, labels = labels, components(links)
            discard(old)
        if turn == 2:
            break
        left = several(labels)
        used.append(left)
        if left.isEmpty():
            break
    discard(*used)
    ends = classes.join(labels, "id", "left").select("digest", F.col("id").alias("__id"), F.coalesce("component", "id").alias("component"))
    out = rows.join(ends, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
