"""Katz backoff language model: training and scoring of whole corpora.

The model has any order from two on.  Counts of at most ``CUTOFF`` are
discounted by Good-Turing, what that frees in a context is spread over the
words not seen there in proportion to the lower order, with weights that make
every distribution sum to one.  The lowest order, of single words, is
discounted in the same way; what it frees belongs to unknown words.  A token's
probability is evaluated recursively: that of its n-gram if it was seen, else
the context's weight times the probability one order below.  Before a text
stand as many marks of its beginning as a context has words.

Nothing is held in one place.  Texts are read once, into files of word numbers
(blocks) of at most about ``BLOCK_TOKENS`` tokens below the shared folder;
counts travel as sorted, compressed arrays, one row for each block and part:

1. blocks send their distinct words to the parts of the vocabulary, which add
   up training counts and send back the words' ids and counts,
2. for each order, blocks send their distinct n-grams, counted, with the
   probability one order below, to the parts of a table of n-grams; contexts
   with more than a fixed share of all tokens are dealt out by n-gram rather
   than by context, and their sums are joined by context and given back,
3. parts discount, normalise and send back probabilities and counts, from which
   blocks make the next order, and in the end the sum for each document.

The driver holds count-of-counts and the sizes of the vocabulary's parts (eight
bytes for each, one for some 13 MB of text).  Words, and contexts of two words
or more, are told apart by 64-bit hashes.

Nulls: a null text is empty and has the end token only; a row with a null id is
trained on.  Rows with equal ids and repeated rows are counted and scored each;
nothing depends on ties.  A very long text is read whole into one block.  Empty
tables give empty results; with no training rows at all, scores are those of a
vocabulary that has only unknown words.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workers_import
from . import files
from .common import discard, drop_shared, lean, release, shared_dir, tasks_for, text_size, written
from .shingles import mixed, slices, words

CUTOFF = 5
#: Bytes of text for each part of a table, and tokens in a block.
PART_BYTES, BLOCK_TOKENS = 13 << 20, 2_500_000
BOS, EOS, UNK, FIRST_ID = 0, 1, 2, 3
_U = np.uint64


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """An array as compressed byte planes, of differences if it never falls."""
    x = np.ascontiguousarray(x)
    if rising and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return x.dtype.str.encode() + (b"+" if rising else b"=") + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    dtype, rising = np.dtype(data[:3].decode()), data[3:4] == b"+"
    planes = np.frombuffer(zstandard.decompress(data[4:]), np.uint8).reshape(dtype.itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(x, dtype=dtype) if rising else x


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges, so that sorted hashes are sorted by part."""
    return ((hashes >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def by_part(where: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each part that occurs and its places, in order."""
    order = np.argsort(where, kind="stable")
    found, start = np.unique(where[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, start[1:]), strict=True))


def discounts(n: list[float]) -> np.ndarray:
    """Factors for counts 0..CUTOFF+1 from count-of-counts n[1..CUTOFF+1]; the last is for all above.

    Good-Turing with Katz's correction, so that what is freed equals the mass
    of words seen once.  Where raw count-of-counts give no factors between 0
    and 1 (as many copies of texts do), a line through their logarithms is used.
    """
    out, k = np.ones(CUTOFF + 2), CUTOFF

    def factors(n: list[float]) -> list[float] | None:
        rest = (k + 1) * n[k + 1] / n[1]
        if rest >= 1:
            return None
        found = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
        return found if all(0 < x <= 1 for x in found) else None

    found, seen = None, [r for r in range(1, k + 2) if n[r] > 0]
    if len(seen) == k + 1:
        found = factors(n)
    if found is None and len(seen) > 1:
        slope, level = np.polyfit(np.log(seen), np.log([n[r] for r in seen]), 1)
        found = factors([0.0, *(float(np.exp(level + slope * np.log(r))) for r in range(1, k + 2))])
    if found is None:  # too few counts: the same amount off each
        amount = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        found = [(r - amount) / r for r in range(1, k + 1)]
    out[1 : k + 1] = found
    return out


@dataclass
class Unigrams:
    tokens: int
    types: int
    docs: int
    factors: np.ndarray
    unknown: float
    scale: float

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(float)
        seen = self.factors[np.minimum(count, CUTOFF + 1).astype(np.int64)] * c / max(1, self.tokens) * self.scale
        return np.where(count > 0, seen, self.unknown)


def unigram_model(of_counts: dict[int, int], tokens: int, types: int, docs: int) -> Unigrams:
    """``of_counts``: how many words have each count up to CUTOFF + 1."""
    n = [0.0, *(float(of_counts.get(r, 0)) for r in range(1, CUTOFF + 2))]
    factors = discounts(n)
    freed = sum(n[r] * r * (1 - factors[r]) for r in range(1, CUTOFF + 1)) / max(1, tokens)
    # nothing freed: no rare words; one more token than there are is left to the unknown ones
    scale = 1.0 if freed > 0 else tokens / (tokens + 1)
    return Unigrams(tokens, types, docs, factors, freed if freed > 0 else 1 / (tokens + 1), scale)


def context_weights(contexts: np.ndarray, seen_p: np.ndarray, lower_p: np.ndarray, seen: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """For rows sorted by context: each row's scale of seen probabilities and weight of the lower order.

    Over a context's seen words, ``seen_p`` and ``lower_p`` are summed, but for
    the contexts in ``known`` (sorted), whose sums come with them; where
    discounting left nothing, seen words give up one part in a thousand.
    """
    start = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]]))
    mass = np.add.reduceat(np.where(seen, seen_p, 0.0), start)
    lower = np.add.reduceat(np.where(seen, lower_p, 0.0), start)
    if len(known[0]) and len(start):
        at = np.minimum(np.searchsorted(known[0], contexts[start]), len(known[0]) - 1)
        dealt = known[0][at] == contexts[start]
        mass[dealt], lower[dealt] = known[1][at[dealt]], known[2][at[dealt]]
    scale, weight = normalised(mass, lower)
    size = np.diff(np.concatenate([start, [len(contexts)]]))
    return np.repeat(scale, size), np.repeat(weight, size)


def normalised(mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unseen = np.maximum(0.0, 1.0 - lower)
    full = unseen < 1e-12  # every word was seen: nothing to back off to
    scale = np.where(full & (mass > 0), 1.0 / np.maximum(mass, 1e-300), np.where(mass > 0.999, 0.999 / np.maximum(mass, 1e-300), 1.0))
    return scale, np.where(full, 0.0, (1.0 - scale * mass) / np.maximum(unseen, 1e-300))


class Block:
    """What a block's file holds: ids, held-out marks and word counts of documents, and their words by place in the vocabulary."""

    def __init__(self, folder: str, number: int):
        raw = bytes(files.mapped(f"{folder}/block-{number:012d}", "u1"))
        size = np.frombuffer(raw[:40], "<i8").tolist()
        at = np.cumsum([40, *size]).tolist()
        self.ids, self.null, self.held, self.counts, self.words = (unpack(raw[a:b]) for a, b in zip(at, at[1:], strict=False))

    @staticmethod
    def write(folder: str, number: int, *arrays: np.ndarray) -> None:
        packed = [pack(x) for x in arrays]
        files.put(f"{folder}/block-{number:012d}", lambda f: f.write(np.array([len(p) for p in packed], "<i8").tobytes() + b"".join(packed)))


@dataclass
class Sizes:
    """What blocks need to know of the corpus."""

    base: np.ndarray
    docs: int
    heavy: float
    parts: int


class Tokens:
    """A block's tokens in order, with contexts of one order after the other."""

    def __init__(self, folder: str, rows: pd.DataFrame, sizes: Sizes):
        self.block, self.sizes, self.order = Block(folder, int(rows["block"].iat[0])), sizes, 2
        rows = rows.sort_values("part")
        ids = np.concatenate([np.where((x := unpack(b)) > 0, x.astype(np.int64) + sizes.base[p] - 1, UNK) for p, b in zip(rows["part"], rows["blob"], strict=True)]).astype(_U)
        counts = np.concatenate([unpack(x) for x in rows["more"]])
        block, n = self.block, len(self.block.words) + len(self.block.counts)
        ends = np.cumsum(block.counts + 1)
        self.first = np.concatenate([[0], ends[:-1]])
        inner = np.ones(n, bool)
        inner[ends - 1] = False
        self.token, self.count = np.full(n, EOS, _U), np.full(n, sizes.docs, np.int64)
        self.token[inner], self.count[inner] = ids[block.words], counts[block.words]
        self.train = np.repeat(block.held == 0, block.counts + 1)
        #: The context of each token and how often it stands in training texts; what tells of the lower order.
        self.context, self.context_count, self.lower = self._after(self.token), self._after(self.count, sizes.docs), self.count

    def _after(self, x: np.ndarray, begin: int = BOS) -> np.ndarray:
        """Of the token before; at the beginning of a text, ``begin``."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = begin
        return out

    def grams(self) -> None:
        """Find the distinct n-grams, by context and token; ``place`` leads from tokens to them, ``where`` from them to parts."""
        self.key = self.context << _U(32) | self.token if self.order == 2 else mixed(mixed(self.context) + self.token)
        _, self.one, place = np.unique(self.key, return_index=True, return_inverse=True)
        self.place = place.astype(np.uint32)  # a block has fewer tokens than that
        if self.order > 2:
            by = np.lexsort((self.token[self.one], self.context[self.one]))
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            self.one, self.place = self.one[by], rank[self.place]
        context, token = self.context[self.one], self.token[self.one]
        by = np.where(self.context_count[self.one] > self.sizes.heavy, mixed(mixed(context) + token), context)
        self.where = part_of(mixed(by + _U(0x51ED270B)), self.sizes.parts)

    def answered(self, rows: pd.DataFrame, column: str, dtype) -> np.ndarray:
        """What the parts said of each distinct n-gram."""
        out, places = np.empty(len(self.one), dtype), dict(by_part(self.where))
        for p, blob in zip(rows["part"], rows[column], strict=True):
            out[places[p]] = unpack(blob)
        return out

    def climb(self, rows: pd.DataFrame) -> None:
        """On to the next order, with the answers of this one: its n-grams are the contexts to come."""
        self.grams()
        p, n = self.answered(rows, "blob", float)[self.place], self.answered(rows, "more", np.int64)[self.place]
        gram = mixed(self.key + _U(self.order)) if self.order == 2 else self.key
        self.order += 1
        self.lower, self.context, self.context_count = p, self._after(gram, self.order), self._after(n, self.sizes.docs)


def _rows(**columns) -> pa.RecordBatch:
    kinds = {"blob": pa.binary(), "more": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


_ANSWER = "part long, block long, kind long, blob binary, more binary"


class Katz:
    """Fit on the rows that aren't held out, score all rows."""

    def __init__(self, docs: DataFrame, held_out: Column, order: int = 2):
        if order < 2:
            raise ValueError("the order is two or more")
        self.spark, self.order = workers_import(docs.sparkSession), order
        self.folder = shared_dir(self.spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
        self.parts = tasks_for(text_size(docs), PART_BYTES)
        self._vocabulary(rows)
        self.known = self.words.select("part", "block", F.lit(0).cast("long").alias("kind"), "blob", "more")
        self.factors = []
        for k in range(2, order + 1):
            answers = self._level(k)
            self.known = self.known.unionByName(written(answers, f"answers-{k}") if k < order else answers)
        self._score()

    def _vocabulary(self, rows: DataFrame) -> None:
        folder, parts = self.folder, self.parts

        def read(batches):
            first, blocks = TaskContext.get().partitionId() << 16, 0
            ids, null, held, counts, found, n = [], [], [], [], [], 0

            def close():
                every, count, out = np.concatenate(found), np.concatenate(counts).astype(np.int64), np.concatenate(held)
                known, place = np.unique(every, return_inverse=True)
                number = np.bincount(place[np.repeat(~out, count)], minlength=len(known)).astype(np.uint32)
                Block.write(folder, first + blocks, np.concatenate(ids), np.concatenate(null).astype(np.uint8), out.astype(np.uint8), count, place.astype(np.uint32))
                cut = np.searchsorted(part_of(known, parts), np.arange(parts + 1))
                docs = int((~out).sum())
                for p in np.flatnonzero((np.diff(cut) > 0) | (np.arange(parts) == 0)).tolist():  # a block always sends something
                    a, b = cut[p], cut[p + 1]
                    yield _rows(part=[p], block=[first + blocks], docs=[docs if p == 0 else 0], blob=[pack(known[a:b], True)], more=[pack(number[a:b])])

            for batch in batches:
                for lo, hi in slices(batch.column(1)):
                    part = batch.slice(lo, hi - lo)
                    numbers, each = words(part.column(1))
                    if n and n + len(numbers) > BLOCK_TOKENS:
                        yield from close()
                        blocks, n = blocks + 1, 0
                        for x in (ids, null, held, counts, found):
                            x.clear()
                    n += len(numbers) + len(each)
                    found.append(numbers)
                    counts.append(each)
                    ids.append(part.column(0).fill_null(0).to_numpy())
                    null.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                    held.append(part.column(2).to_numpy(zero_copy_only=False))
            if ids:
                yield from close()

        sent = rows.mapInArrow(lean(read), "part long, block long, docs long, blob binary, more binary")

        def add_up(rows: pd.DataFrame) -> pd.DataFrame:
            hashes = [unpack(x) for x in rows["blob"]]
            counts = [unpack(x) for x in rows["more"]]
            known, place = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate(counts), minlength=len(known)).astype(np.int64)
            rank = np.cumsum(total > 0)  # from 1; unknown words have none
            few = [int((total == r).sum()) for r in range(1, CUTOFF + 2)]
            sums = [int(rank[-1]) if len(rank) else 0, int(total.sum()), int(rows["docs"].sum()), *few]
            at = np.cumsum([0, *map(len, hashes)])
            blobs, more = [], []
            for a, b in zip(at, at[1:], strict=False):
                own = place[a:b]
                blobs.append(pack(np.where(total[own] > 0, rank[own], 0).astype(np.uint32)))
                more.append(pack(total[own]))
            first = [sums] + [[]] * (len(rows) - 1)
            return pd.DataFrame({"part": rows["part"], "block": rows["block"], "sums": first, "blob": blobs, "more": more})

        answers = sent.groupBy("part").applyInPandas(add_up, "part long, block long, sums array<long>, blob binary, more binary")
        self.words = written(answers, "words")
        sums = self.words.where(F.size("sums") > 0)
        total = sums.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(CUTOFF + 4)]).first()
        types, tokens, docs, *few = map(int, total)
        if types + FIRST_ID >= 1 << 32:
            raise ValueError("more words than ids of 32 bits")
        # eight bytes for each part
        of = sums.select("part", F.col("sums")[0].alias("n")).toArrow()
        size = np.zeros(parts, np.int64)
        size[of.column(0).to_numpy()] = of.column(1).to_numpy()
        of_counts = dict(enumerate(few, 1))
        if docs:  # the end of a text is a token of its own
            types, tokens = types + 1, tokens + docs
            if docs <= CUTOFF + 1:
                of_counts[docs] = of_counts.get(docs, 0) + 1
        self.uni = unigram_model(of_counts, tokens, types, docs)
        self.sizes = Sizes(FIRST_ID + np.cumsum(size) - size, docs, max(16.0, tokens / (8 * parts)), parts)

    def _tokens(self):
        """A block's tokens at the order that its rows allow."""
        folder, sizes = self.folder, self.sizes

        def at(rows: pd.DataFrame, order: int) -> Tokens:
            own = Tokens(folder, rows[rows["kind"] == 0], sizes)
            while own.order < order:
                own.climb(rows[rows["kind"] == own.order])
            own.grams()
            return own

        return at

    def _level(self, k: int) -> DataFrame:
        """Count the n-grams of order ``k`` and answer each block's with probabilities (logarithms for the last order) and counts."""
        at, uni, heavy, folder, last = self._tokens(), self.uni, self.sizes.heavy, self.folder, k == self.order

        def send(rows: pd.DataFrame) -> pd.DataFrame:
            own = at(rows, k)
            number = np.bincount(own.place[own.train], minlength=len(own.one)).astype(np.uint32)
            block, out = int(rows["block"].iat[0]), []
            for p, of in by_part(own.where):
                one = own.one[of]
                out.append((p, block, pack(own.context[one], True), pack(own.token[one].astype(np.uint32)), pack(number[of]), pack(own.lower[one]), pack(own.context_count[one])))
            del own
            release()
            return pd.DataFrame(out, columns=["part", "block", "context", "token", "n", "lower", "contexts"])

        arrays = "context binary, token binary, n binary, lower binary, contexts binary"
        sent = self.known.groupBy("block").applyInPandas(send, f"part long, block long, {arrays}")

        def add_up(rows: pd.DataFrame) -> pd.DataFrame:
            each = [unpack(x) for x in rows["context"]]
            context, token = np.concatenate(each), np.concatenate([unpack(x) for x in rows["token"]])
            by = np.lexsort((token, context))
            new = np.ones(len(by), bool)
            new[1:] = (context[by][1:] != context[by][:-1]) | (token[by][1:] != token[by][:-1])
            one = by[new]
            place = np.empty(len(by), np.int64)
            place[by] = np.cumsum(new) - 1
            total = np.bincount(place, weights=np.concatenate([unpack(x) for x in rows["n"]]), minlength=len(one)).astype(np.int64)
            lower, contexts = (np.concatenate([unpack(x) for x in rows[c]])[one] for c in ("lower", "contexts"))
            cut = np.cumsum([0, *map(len, each)])
            asked = [(int(b), pack(place[x:y].astype(np.uint32), True)) for b, x, y in zip(rows["block"], cut, cut[1:], strict=False)]
            few = [int((total == r).sum()) for r in range(1, CUTOFF + 2)]
            return pd.DataFrame({"part": [rows["part"].iat[0]], "few": [few], "context": [pack(context[one], True)], "n": [pack(total)], "lower": [pack(lower)], "contexts": [pack(contexts)], "asked": [asked]})

        schema = "part long, few array<long>, context binary, n binary, lower binary, contexts binary, asked array<struct<block:long,place:binary>>"
        table = written(sent.groupBy("part").applyInPandas(add_up, schema), f"order-{k}")
        few = table.agg(*[F.coalesce(F.sum(F.col("few")[i]), F.lit(0)) for i in range(CUTOFF + 1)]).first()
        factors = discounts([0.0, *map(float, few)])
        self.factors.append(factors)

        def probabilities(n, lower, contexts):
            """Of each row the seen probability before scaling, the lower order's, and whether it was seen."""
            seen_p = factors[np.minimum(n, CUTOFF + 1)] * n / np.maximum(1, contexts)
            return seen_p, uni.p(lower) if k == 2 else lower, n > 0

        def heavy_sums(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    part, *blobs = (batch.column(c)[i].as_py() for c in range(5))
                    contexts_of, n, lower, contexts = map(unpack, blobs)
                    seen_p, lower_p, seen = probabilities(n, lower, contexts)
                    own = contexts > heavy
                    found, place = np.unique(contexts_of[own], return_inverse=True)
                    mass, low = (np.bincount(place, weights=np.where(seen, x, 0.0)[own], minlength=len(found)) for x in (seen_p, lower_p))
                    # a row of its own for each part, so that each gets its file
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(found) + 1, part)), pa.array([*([True] * len(found)), False]), pa.array(np.append(found.view(np.int64), 0)), pa.array(np.append(mass, 0.0)), pa.array(np.append(low, 0.0))],
                        names=["part", "real", "context", "mass", "lower"],
                    )

        sums = table.select("part", "context", "n", "lower", "contexts").mapInArrow(heavy_sums, "part long, real boolean, context long, mass double, lower double")
        sums = written(sums, f"heavy-{k}")
        total = sums.where("real").groupBy("context").agg(F.sum("mass").alias("all_mass"), F.sum("lower").alias("all_lower"))
        back = sums.join(total, "context", "left").select("part", "real", "context", "all_mass", "all_lower")

        def keep(rows: pd.DataFrame) -> pd.DataFrame:
            own = rows[rows["real"]]
            found = own["context"].to_numpy(np.int64).view(_U)
            by = np.argsort(found)
            packed = [pack(x) for x in (found[by], own["all_mass"].to_numpy(float)[by], own["all_lower"].to_numpy(float)[by])]
            files.put(f"{folder}/heavy-{k}-{rows['part'].iat[0]:012d}", lambda f: f.write(np.array([len(p) for p in packed], "<i8").tobytes() + b"".join(packed)))
            return rows[["part"]].head(1)

        back.groupBy("part").applyInPandas(keep, "part long").write.format("noop").mode("overwrite").save()
        discard(sums)

        def answer(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    part, *blobs = (batch.column(c)[i].as_py() for c in range(5))
                    context, n, lower, contexts = map(unpack, blobs)
                    raw = bytes(files.mapped(f"{folder}/heavy-{k}-{part:012d}", "u1"))
                    cut = np.cumsum([24, *np.frombuffer(raw[:24], "<i8")]).tolist()
                    known = tuple(unpack(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False))
                    seen_p, lower_p, seen = probabilities(n, lower, contexts)
                    scale, weight = context_weights(context, seen_p, lower_p, seen, known)
                    p = np.maximum(np.where(seen, scale * seen_p, weight * lower_p), 1e-300)
                    p = np.log10(p) if last else p
                    for ask in batch.column(5)[i].as_py():
                        place = unpack(ask["place"])
                        yield _rows(part=[part], block=[ask["block"]], kind=[k], blob=[pack(p[place])], more=[b"" if last else pack(n[place])])

        return table.select("part", "context", "n", "lower", "contexts", "asked").mapInArrow(lean(answer), _ANSWER)

    def _score(self) -> None:
        at, uni, order = self._tokens(), self.uni, self.order

        def score(rows: pd.DataFrame) -> pd.DataFrame:
            own = at(rows, order)
            each = own.answered(rows[rows["kind"] == order], "blob", float)
            block = own.block
            add = lambda x: np.add.reduceat(x, own.first)
            ids = pd.array(block.ids, dtype="Int64")
            ids[block.null > 0] = pd.NA
            out = pd.DataFrame(
                {
                    "doc_id": ids,
                    "held_out": block.held > 0,
                    "n_tokens": block.counts + 1,
                    "n_known": add((own.count > 0).astype(np.int64)),
                    "train_tokens": np.int64(uni.tokens),
                    "base_score": add(np.log10((own.count + 1) / (uni.tokens + uni.types + 1))),
                    "score": add(each[own.place]),
                }
            )
            del own, each
            release()
            return out

        self.scores = self.known.groupBy("block").applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def forget(self) -> None:
        """Delete the blocks; scores can't be computed after this."""
        drop_shared(self.spark, self.folder)


def score(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    return Katz(docs, held_out, order).scores
