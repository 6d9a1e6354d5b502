"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers;
these spans always stay.  Around them a wider net of candidates is cast: what
the base rules drop, national phone numbers, addresses written out with "at"
and "dot", and long random strings as keys and tokens are.  Labelers of three
kinds vote on each candidate, for, against or not at all:

* patterns: exact form, checksum or range, randomness of the characters,
* gazetteers: known top-level domains, calling codes, words for secrets,
* context: cue words before the span, signs of versions and measures around it.

Expectation-maximisation over the counts of vote patterns (there are at most
``3 ** 6`` of them beside the features' bits, however large the data are)
estimates how reliable each labeler is and how likely each pattern is personal
data.  These probabilities train the final span classifier, a logistic
regression over features of the span; candidates it gives one half or more are
added to the base spans where they don't overlap one.

Statistics cover all documents.  Spans are half-open, in code points, in order
of their starts; ties go by kind.  Nulls: a null text has no spans and stays
null.  Rows with equal ids and repeated rows are searched each; very long texts
are searched whole.  Empty tables give empty results.  All columns are kept; a
column named ``pii_spans`` is replaced by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import workers_import
from .common import by_place, lean
from .shingles import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "address", "national", "written", "secret")
#: Bytes of text that become Python strings at a time.
_BYTES = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of these can begin inside a run of digits but at its start, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+.)\x20(-])(?:\x20|^)?(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])")
_WRITTEN = re.compile(r"\b[A-Za-z0-9._-]{2,40}\x20?[\[(]?\bat\b[\])]?\x20?[A-Za-z0-9-]{2,40}\x20?[\[(]?\bdot\b[\])]?\x20?[A-Za-z]{2,8}\b")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+")
_DIGIT = re.compile("[0-9]")

#: Fixed values.
TOP_LEVEL = frozenset("com org net edu gov info io de fr es uk eu us".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
SECRET_WORDS = re.compile(r"(?i)\b(?:token|secret|password|passwd|api|key|bearer|credential)\b")
CUES = {
    "email": re.compile(r"(?i)mail|contact|write|reply"),
    "ip": re.compile(r"(?i)\bip\b|host|server|address|login"),
    "card": re.compile(r"(?i)card|visa|credit|payment|account"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|contact"),
    "secret": re.compile(r"[=:]\s*[\x22']?$"),
}
_CUE_OF = {"account": "card", "address": "ip", "national": "phone", "written": "email"}
_AGAINST = re.compile(r"(?i)(?:version|release|isbn|rev|v|no|#|§|\$|€)[\x20.:]*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            last = end.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of base spans and of everything else worth a vote, by start, then kind."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            out.append(("ip" if all(map(_small, m[0].split("."))) else "address", *m.span()))
        for m in _CARD.finditer(text):
            if 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19:
                out.append(("card" if luhn(digits) else "account", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
        out += [("national", *m.span(1)) for m in _NATIONAL.finditer(text)]
        out += [("secret", *m.span()) for m in _SECRET.finditer(text) if _DIGIT.search(m[0])]
    if " dot" in text or "dot" in text and "at" in text:
        out += [("written", *m.span()) for m in _WRITTEN.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _randomness(s: str) -> float:
    """Bits a character, from the string's own frequencies."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def judge(text: str, kind: str, start: int, end: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Six votes (1, -1 or 0 for none) and the features' bits of one candidate."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    digits = "".join(c for c in span if "0" <= c <= "9")
    cue = bool(CUES[_CUE_OF.get(kind, kind)].search(before))
    word = bool(SECRET_WORDS.search(before))
    form = 1 if kind in BASE_KINDS else -1 if kind in ("account", "address") else 0
    if kind in ("card", "account"):
        check = 1 if luhn(digits) else -1
    elif kind in ("ip", "address"):
        check = 1 if kind == "ip" and not span.startswith(("0.", "255.")) else -1
    elif kind == "secret":
        check = 1 if _randomness(span) > 3.2 and len(set(span)) >= 10 else -1
    else:
        check = 1 if len(set(digits)) > 3 else 0
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in TOP_LEVEL else -1
    elif kind == "written":
        gazetteer = 1 if span.split()[-1].strip("[]()").lower() in TOP_LEVEL else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(CALLING_CODES) else -1
    elif kind == "secret":
        gazetteer = 1 if word else -1
    else:
        gazetteer = 0
    context = 1 if cue else 0
    around = -1 if _AGAINST.search(before) else 0
    flat = -1 if len(digits) > 5 and len(set(digits)) < 4 else 0
    features = [int(kind == k) for k in KINDS] + [int(cue), int(word), int(check > 0), int(check < 0), int(gazetteer > 0), int(gazetteer < 0), int(around < 0 or flat < 0)]
    return (form, check, gazetteer, context, around, flat), tuple(features)


@dataclass
class Model:
    weights: tuple[float, ...] = ()
    reliability: tuple[tuple[float, float], ...] = ()

    def probability(self, features: tuple[int, ...]) -> float:
        z = self.weights[0] + sum(w for w, f in zip(self.weights[1:], features, strict=True) if f) if self.weights else -10.0
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        found = candidates(text or "")
        base = [x for x in found if x[0] in BASE_KINDS]
        out, last = list(base), -1
        # both lists go by start: ``reach`` is the furthest end of base spans that begin before the candidate's end
        nth, reach = 0, [0]
        for _, _, y in base:
            reach.append(max(reach[-1], y))
        for kind, a, b in found:
            if kind in BASE_KINDS or a < last:
                continue
            while nth < len(base) and base[nth][1] <= a:
                nth += 1
            upto = nth
            while upto < len(base) and base[upto][1] < b:
                upto += 1
            if reach[nth] > a or upto > nth:
                continue
            if self.probability(judge(text, kind, a, b)[1]) >= 0.5:
                out.append((kind, a, b))
                last = b
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """For vote patterns (rows of -1, 0, 1) and their counts: probabilities, and each labeler's two hit rates.

    A labeler that is silent says nothing; its rates are those of its votes on
    true and on false spans, with a prior that they are better than chance.
    """
    p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    rates = np.zeros((votes.shape[1], 2))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        rate = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        score = np.log(rate[1] / rate[0]) * np.ones(len(p))
        for j in range(votes.shape[1]):
            v = votes[:, j]
            true = (weight[1][v > 0].sum() + 8) / (weight[1][v != 0].sum() + 10)
            false = (weight[0][v < 0].sum() + 8) / (weight[0][v != 0].sum() + 10)
            rates[j] = true, false
            score += np.where(v > 0, math.log(true / (1 - false)), np.where(v < 0, math.log((1 - true) / false), 0.0))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, rates


def fit(docs: DataFrame) -> Model:
    """Count vote patterns over all documents, estimate reliabilities, train the classifier."""
    workers_import(docs.sparkSession)

    def patterns(batches):
        seen: Counter = Counter()
        for batch in batches:
            for lo, hi in slices(batch.column(0), _BYTES):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    for kind, a, b in candidates(text or ""):
                        seen[judge(text, kind, a, b)] += 1
        keys = [",".join(map(str, v)) + "|" + ",".join(map(str, f)) for v, f in seen]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    found = docs.select("text").mapInArrow(lean(patterns), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not found:
        return Model()
    split = [[[int(x) for x in part.split(",")] for part in r[0].split("|")] for r in found]
    votes, bits = (np.array([s[i] for s in split], float) for i in (0, 1))
    counts = np.array([float(r[1]) for r in found])
    p, rates = expectation_maximisation(votes, counts)
    X, beta = np.concatenate([np.ones((len(p), 1)), bits], 1), np.zeros(bits.shape[1] + 1)
    # Newton's method; a ridge keeps features that never vary near zero
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        gradient = X.T @ (counts * (p - q)) - 0.1 * beta
        hessian = (X * (counts * q * (1 - q))[:, None]).T @ X + 0.1 * np.eye(X.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(map(float, beta)), tuple(map(tuple, rates.tolist())))


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` and pii_spans; a column of that name is replaced."""
    workers_import(docs.sparkSession)
    own = [i for i, c in enumerate(docs.columns) if c.lower() != "pii_spans"]
    names = [*(docs.columns[i] for i in own), "pii_spans"]

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for lo, hi in slices(batch.column(0), _BYTES):
                part = batch.slice(lo, hi - lo)
                found = (model.spans(t) for t in part.column(0).to_pylist())
                spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in own), spans], names=names)

    return by_place(docs, "text").mapInArrow(lean(run), T.StructType([*(docs.schema.fields[i] for i in own), T.StructField("pii_spans", T.ArrayType(_SPAN))]))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with [KIND] for each span of its texts; n_chars, if there is one, counts the new text."""
    workers_import(docs.sparkSession)
    names = docs.columns
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType == T.LongType() else None

    def run(batches):
        for batch in batches:
            for lo, hi in slices(batch.column(0), _BYTES):
                part = batch.slice(lo, hi - lo)
                texts = [t and redacted(t, model.spans(t)) for t in part.column(0).to_pylist()]
                columns = list(part.columns[1:])
                columns[at] = pa.array(texts, pa.string())
                if counted is not None:
                    columns[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return by_place(docs, "text").mapInArrow(lean(run), docs.schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def of_kind(kind: str) -> Column:
    return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")


def joined(base_only: bool = False) -> Column:
    """kind:start:end of the spans, joined by commas."""
    spans = F.col("pii_spans")
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
