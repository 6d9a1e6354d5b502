"""Toxicity by maximum-scoring segments over token log-odds.

Training uses labelled rows only, at most about ``MAX_LABELS`` of them, picked
by a hash of the id.  A token's weight is its log-odds of standing in toxic
rather than clean texts, counted by documents, under a Dirichlet prior: each
token has a pseudo-count of ``PSEUDO`` and a part in proportion to its background
frequency, worth ``PRIOR_DOCS`` documents in all.  Weights are lowered by a
drift that makes ordinary prose score below zero.  The model keeps every token
that a labelled toxic document holds, which the labelled rows bound; the others
can only lower a sum and share one weight.  Where training rows are scored to
calibrate the model, each is left out of its own tokens' counts.

A text is scanned once in linear time for all maximal scoring segments: runs of
tokens whose sum no extension or shortening raises.  For texts of clean
documents the best sum follows an extreme-value distribution, whose two
parameters come from the clean training rows: lambda solves ``E[exp(lambda *
weight)] = 1``, K matches the mean of the best sums.  A segment of sum s in a
text of n tokens has the E-value ``K * n * exp(-lambda * s)``; segments with
less than ``MAX_E`` are significant passages, their ``-log10 E`` add up to a
text's evidence, and a logistic curve fitted to binned evidence of training
rows turns it into a probability.

Tokens are runs of letters, A-Z in lower case, told apart by 64-bit hashes.
Only the text is scored, and the whole of it, however long.  Nulls: a null text
is empty, which scores as a text without evidence; null labels are not used,
and of several labels of an id the highest counts.  Without labelled rows of
both kinds all scores are the share of toxic ones, 0 if there are none.  Rows
with equal ids and repeated rows are learned from and scored each; ties between
segments go to the first.  Empty tables give empty results.  Columns of the
documents whose names are those of results are replaced by ``score`` and kept
by ``clean``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_import
from .common import by_place, discard, lean, written
from .shingles import slices
from .shingles import words as hashed

MAX_LABELS = 200_000
PSEUDO, PRIOR_DOCS, DRIFT, WEIGHT_RANGE, MAX_E = 1.0, 25.0, 1.5, (-3.0, 6.0), 0.1
#: Bytes of text, and tokens whose counts are kept, at a time.
_BYTES, _TOKENS = 1 << 20, 2_000_000
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens in order, and how many each text has."""
    return hashed(texts, _NO_LETTER)


@dataclass
class Model:
    """``known`` tokens, sorted, with the labelled documents of either kind that hold them."""

    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Tokens of toxic and clean documents, counted once a document; how many are distinct; documents.
    totals: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] | None = None
    prior: float = 0.0

    def log_odds(self, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        n_toxic, n_clean, types, docs = self.totals
        share = PRIOR_DOCS / docs
        every = PSEUDO * types + share * (n_toxic + n_clean)
        own = PSEUDO + share * (toxic + clean)
        odds = np.log((toxic + own) / (n_toxic + every - toxic - own)) - np.log((clean + own) / (n_clean + every - clean - own))
        return np.clip(odds, *WEIGHT_RANGE)

    def weights(self, numbers: np.ndarray, left_out: int | None = None) -> np.ndarray:
        """Of tokens; ``left_out`` is the kind of a training row that they come from."""
        if not len(self.known):
            return np.full(len(numbers), -DRIFT)
        at = np.minimum(np.searchsorted(self.known, numbers), len(self.known) - 1)
        toxic, clean = (x[at] - float(left_out == kind) for x, kind in ((self.toxic, 1), (self.clean, 0)))
        found = (self.known[at] == numbers) & (toxic > 0)
        return np.where(found, self.log_odds(np.maximum(toxic, 0), np.maximum(clean, 0)), 0.0) - DRIFT

    def passages(self, w: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments (start, end, E-value) of a text's weights."""
        n = len(w)
        found = ((a, b, self.k * n * math.exp(-self.lam * s)) for a, b, s in maximal_segments(w))
        return [x for x in found if x[2] < MAX_E]

    def probability(self, evidence: float) -> float:
        if self.curve is None:
            return self.prior
        z = self.curve[0] + self.curve[1] * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def evidence(passages: list[tuple[int, int, float]]) -> float:
    return sum(-math.log10(max(e, 1e-300)) for _, _, e in passages)


def maximal_segments(w: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a row of weights, in linear time.

    A stack holds candidates with the sums before and after them.  A new
    positive weight joins all candidates from the nearest one that starts lower
    and ends lower than it does; weights that aren't positive only move the sum.
    """
    at = np.flatnonzero(w > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(w)])
    stack: list[list] = []  # start, end, sum before, sum after, index of the nearest that starts lower
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, end, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - x) for a, b, x, r, _ in stack]


def labelled(labels: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, toxic) to learn from: at most about ``MAX_LABELS`` rows."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out)
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    if n > MAX_LABELS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(MAX_LABELS / n * (1 << 20))))
    return own


def _of_kinds(batch: pa.RecordBatch):
    """(kind, numbers, how many each text has) of runs of rows (text, toxic)."""
    for lo, hi in slices(batch.column(0), _BYTES):
        part = batch.slice(lo, hi - lo)
        for kind in (0, 1):
            yield kind, *tokens(part.column(0).filter(pa.array(part.column(1).to_numpy() == kind)))


def _counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): the documents of each kind that hold a token."""

    def run(batches):
        kept: tuple[list, list] = ([], [])

        def out():
            for kind in (0, 1):
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept[kind]]), return_counts=True)
                kept[kind].clear()
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(n if kind == k else np.zeros_like(n)) for k in (1, 0))], names=["token", "toxic", "clean"])

        held = 0
        for batch in batches:
            for kind, numbers, each in _of_kinds(batch):
                kept[kind].extend(map(np.unique, np.split(numbers, np.cumsum(each)[:-1])))
                held += len(numbers)
                if held > _TOKENS:
                    yield from out()
                    held = 0
        yield from out()

    return rows.select("text", "toxic").mapInArrow(lean(run), "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` (doc_id, toxic) marks and for which ``held_out`` is false."""
    workers_import(docs.sparkSession)
    own = labelled(labels, held_out)
    # bounded by MAX_LABELS rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))
    size = dict(rows.groupBy("toxic").agg(F.count(F.lit(1))).collect())
    model = Model(prior=size.get(1, 0) / max(1, sum(size.values())))
    if len(size) < 2:
        return model
    counts = written(_counts(rows), "counts")
    total = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0)), F.count(F.lit(1))).first()
    model.totals = (float(total[0]), float(total[1]), float(total[2] + 1), float(sum(size.values())))
    found = counts.where("toxic > 0").toArrow()
    known, toxic, clean = (found.column(i).to_numpy() for i in range(3))
    discard(counts)
    order = np.argsort(known.view(np.uint64))
    model.known, model.toxic, model.clean = known.view(np.uint64)[order], toxic[order].astype(np.float32), clean[order].astype(np.float32)
    return _calibrate(model, rows)


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """Extreme-value parameters from clean rows, then the curve from all."""

    def weights_of(batches):
        seen: Counter = Counter()
        best, n = 0.0, 0
        lengths = 0.0
        for batch in batches:
            for kind, numbers, each in _of_kinds(batch):
                if kind:
                    continue
                w = model.weights(numbers, left_out=0)
                rounded, many = np.unique(np.round(w, 1), return_counts=True)
                seen.update(dict(zip(rounded.tolist(), many.tolist(), strict=True)))
                for x in np.split(w, np.cumsum(each)[:-1]):
                    if len(x):
                        best += max((s for _, _, s in maximal_segments(x)), default=0.0)
                        lengths += math.log(len(x))
                        n += 1
        yield pa.RecordBatch.from_pydict({"w": [*map(float, seen), -99.0, -98.0, -97.0], "n": [*map(float, seen.values()), best, lengths, float(n)]})

    sums = {r[0]: r[1] for r in rows.mapInArrow(lean(weights_of), "w double, n double").groupBy("w").agg(F.sum("n")).collect()}
    best, lengths, n = (sums.pop(x, 0.0) for x in (-99.0, -98.0, -97.0))
    total = sum(sums.values())
    if n and total:
        w, p = np.array(list(sums)), np.array(list(sums.values())) / total
        lo, hi = 1e-3, 64.0
        for _ in range(60):  # the positive root: below it the mean is under 1
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(mid * w)).sum() < 1 else (lo, mid)
        model.lam = lo
        model.k = math.exp(model.lam * best / n - lengths / n - 0.5772156649)
    step = 0.1

    def binned(batches):
        count: Counter = Counter()
        for batch in batches:
            for kind, numbers, each in _of_kinds(batch):
                w = model.weights(numbers, left_out=kind)
                count.update((round(math.log1p(evidence(model.passages(x))) / step), kind) for x in np.split(w, np.cumsum(each)[:-1]) if len(each))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([k[0] for k in count], [k[1] for k in count], list(count.values()))], names=["bin", "toxic", "n"])

    bins = rows.mapInArrow(lean(binned), "bin long, toxic long, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect()
    x, y, m = (np.array([float(r[i]) for r in bins]) for i in range(3))
    model.curve = _logistic(x * step, y, m)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge; the slope stays above zero."""
    X, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        gradient = X.T @ (m * (y - p)) - 1e-3 * beta
        hessian = (X * (m * p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(1e-6, float(beta[1]))


_PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _scored(model: Model, texts: pa.Array) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
    """Probability and significant passages of each text."""
    numbers, each = tokens(texts)
    found = [model.passages(w) for w in np.split(model.weights(numbers), np.cumsum(each)[:-1])] if len(each) else []
    return [model.probability(evidence(p)) for p in found], found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and toxic_score, toxic_passages (array of token start, end)."""
    workers_import(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), _BYTES):
                part = batch.slice(lo, hi - lo)
                probability, passages = _scored(model, part.column(0))
                spans = pa.array([[{"start": a, "end": b} for a, b, _ in p] for p in passages], _PASSAGES)
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in own), pa.array(probability, pa.float64()), spans], names=names)

    ours = ["toxic_score", "toxic_passages"]
    own = [i for i, c in enumerate(docs.columns) if c.lower() not in ours]
    names = [*(docs.columns[i] for i in own), *ours]
    more = [T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_passages", T.ArrayType(_SPAN))]
    return by_place(docs, "text").mapInArrow(lean(run), T.StructType([*(docs.schema.fields[i] for i in own), *more]))


def clean(docs: DataFrame, model: Model, below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose probability is less than ``below``, with all of their columns."""
    workers_import(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), _BYTES):
                part = batch.slice(lo, hi - lo)
                keep = pa.array(np.array(_scored(model, part.column(0))[0]) < below)
                yield pa.RecordBatch.from_arrays(part.columns[1:], names=names).filter(keep)

    names = docs.columns
    return by_place(docs, "text").mapInArrow(lean(run), docs.schema)
