"""The pipeline over the smallest tables and over odd rows: each stage against what it should keep."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, mixing, near, packing, pii, shingles, tokens, toxicity

from .test_operators import brute_added, brute_best_fit, brute_components, brute_takes, encoded

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
tokenizer_path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def check_near_dedup(before, after):
    rows = rows_of(before, "doc_id", "text")
    component = brute_components(rows, 5)
    assert Counter(rows_of(after, "doc_id", "text")) == Counter(r for r in rows if r[0] is None or component[r[0]] == r[0])


def check_pii(before, after):
    model = pii.fit(before)
    want = [(d, t and pii.redacted(t, brute_added(t, model))) for d, t in rows_of(before, "doc_id", "text")]
    assert Counter(rows_of(after, "doc_id", "text")) == Counter(want)
    assert all(n == (None if t is None else len(t)) for t, n in rows_of(after, "text", "n_chars"))


def check_mixing(before, after):
    rows = rows_of(before, "doc_id", "text", "source")
    want, texts = Counter(), defaultdict(list)
    for d, _, taken in brute_takes(rows):
        want[d] += taken
    for d, t, _ in rows:
        texts[d].append(t or "")
    found = Counter()
    for d, t in rows_of(after, "doc_id", "text"):
        found[d] += len(WORD.findall(t))
        assert any(x.startswith(t) for x in texts[d])
    assert found == +want


def check_packing(before, after):
    coder = tokens.Encoder(tokenizer_path, 4)
    texts = rows_of(before, "doc_id", "text")
    want = Counter((d, len(x) + 1) for (d, _), x in zip(texts, encoded(coder, [t for _, t in texts]), strict=True))
    total, sequences, lengths = Counter(), defaultdict(list), []
    for d, n, sequence, offset, ids in rows_of(after, "doc_id", "length", "sequence_id", "offset", "ids"):
        total[d] += n
        sequences[sequence].append((offset, n))
        lengths.append(n)
        assert len(ids) == 2 * n
    assert total == Counter({d: sum(n * m for (x, n), m in want.items() if x == d) for d in {x for x, _ in want}})
    assert sorted(2048 - sum(n for _, n in s) for s in sequences.values()) == brute_best_fit(lengths, 2048)
    for s in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:], strict=False)) and min(s)[0] == 0


CHECKS = {"near_dedup": check_near_dedup, "pii": check_pii, "mixing": check_mixing, "packing": check_packing}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
        if name in CHECKS:
            CHECKS[name](before, docs)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in seen["toxicity"])
    assert after <= before and len((before - after) - toxic) <= 0.03 * len(before)
    # no two left are near copies
    left = seen["near_dedup"][1].select("doc_id", "text").collect()
    sets = shingles.sets([r.text for r in left], 5)
    for i, x in enumerate(sets):
        for y in sets[:i]:
            both = len(set(x.tolist()) & set(y.tolist()))
            assert not (len(x) and 100 * both >= 80 * (len(x) + len(y) - both))
    for r in seen["pii"][1].collect():
        assert not [s for s in pii.candidates(re.sub(r"\[[A-Z]+\]", "~", r.text)) if s[0] in pii.BASE_KINDS]
    assert seen["pii"][0].count() == seen["pii"][1].count()
    packed = seen["packing"][1]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == seen["packing"][0].select("doc_id").distinct().count()


#: Names that stages use inside.
CLASHES = ("toxic_score", "toxic_passages", "pii_spans", "component_id", "kept", "key", "words", "target", "rest", "piece", "length", "ids", "chunk", "sequence_id", "__text", "hash")


@pytest.mark.parametrize("name", STAGES)
def test_stage_over_odd_rows(spark, make, odd, tmp_path, name):
    """Nulls in any column, empty and very long texts, repeated rows, ties, clashing names, an empty table."""
    rows = [*odd, odd[5], (None, None, None), (300, "mail a@b.com or 10.0.0.1 to " + "me " * 60, "a"), (301, "idiot " * 9 + "x", "a")]
    docs = make(rows).withColumns({c: F.lit(f"theirs {c}") for c in CLASHES}).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    marks = {100 + i: int(i % 3 == 0) for i in range(60)}
    spark.createDataFrame([*marks.items(), (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = STAGES[name](spark, docs, str(tmp_path))
    if name != "packing":
        assert out.columns == docs.columns
        assert all(set(r) == {f"theirs {c}" for c in CLASHES} for r in rows_of(out, *CLASHES))
    if name == "toxicity":
        # the scores themselves are held against brute force in test_operators
        labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
        scores = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(False))).collect()
        assert len(scores) == len(rows)
        assert Counter(rows_of(out, "doc_id", "text")) == Counter((r.doc_id, r.text) for r in scores if r.toxic_score < 0.5)
    else:
        CHECKS[name](docs, out)
    empty = STAGES[name](spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns


@pytest.mark.parametrize("name", STAGES)
def test_a_task_needs_one_python_worker(spark, make, odd, tmp_path, monkeypatch, name):
    """Functions of Python that follow one another in a task have a worker process each, which stays."""
    plans = []
    for module in (mixing, near, packing, toxicity):
        monkeypatch.setattr(module, "written", lambda df, name="table", f=common.written: plans.append(df) or f(df, name))
    spark.createDataFrame([(100 + i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plans.append(STAGES[name](spark, make(odd), str(tmp_path)))

    def workers(node):
        """Most in one task that ends with this node, and most in any task below."""
        if node.nodeName() == "AdaptiveSparkPlan":
            return workers(node.initialPlan())
        below = [workers(c) for c in (node.children().apply(i) for i in range(node.children().size()))]
        own = bool(re.search("InArrow|InPandas|EvalPython", node.nodeName())) + max((x for x, _ in below), default=0)
        return 0 if "Exchange" in node.nodeName() else own, max([own, *(y for _, y in below)])

    assert max(workers(df._jdf.queryExecution().executedPlan())[1] for df in plans) <= 1
