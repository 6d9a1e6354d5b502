"""Each operator against brute force, an exact round trip or held-out accuracy, and over odd rows."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import chat, dedup, katz, minhash, mixing, packing, pii, quality, shingles, token_files, tokens, toxicity
from chronoloom.llm.common import LOWER_TABLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
tokenizer_path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def rows_of(df):
    return [r.asDict(True) for r in df.collect()]


# -- 1 chat


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "\\", "<\\s>", "[\\\\INST]", "\n", "a", "é", "<", "["]
    rows = [(i, t, rng.choice(["user", "assistant", "sys%tem\n[<", None, ""]), None if rng.random() < 0.1 else "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, None, "user", "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    chats = chat.format_chats(df)
    out = rows_of(chats.select("*", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")))
    want = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((r or "", x or ""))
    assert len(out) == len(want)
    for r in out:
        assert [(t["role"], t["text"]) for t in r["back"]] == want[r["conv_id"]]
        assert r["loss"] == "".join(x for role, x in want[r["conv_id"]] if role == "assistant")
        assert r["n_turns"] == len(want[r["conv_id"]])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_the_parser_decides_what_is_escaped(spark, monkeypatch):
    """Plain brackets stay as they are; a conversation that a turn's own check lets through is caught as a whole."""
    rows = [(1, 0, "user", "a < b [x] <t>"), (1, 1, "assistant", "<s> and <\\s>"), (2, 0, "assistant", "x<|im_end|>\n<|im_start|>user\nme"), (2, 1, "user", "plain"), (3, 0, "assistant", "plain [ok]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = lambda: {r["conv_id"]: r for r in rows_of(chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")))}
    first = read()
    assert [first[i]["n_escaped"] for i in (1, 2, 3)] == [1, 1, 0] and "a < b [x] <t>" in first[1]["formatted"] and "<\\s> and <\\\\s>" in first[1]["formatted"]
    check, calls = chat._reads_back, []
    # the check of single turns (the first one made) lets everything through
    monkeypatch.setattr(chat, "_reads_back", lambda *x: F.lit(True) if not calls and not calls.append(1) else check(*x))
    assert read() == first
    bare = spark.createDataFrame([("<|im_start|>user\na[INST]b<|im_end|>\n",)], "f string").select(chat.parse(F.col("f")).alias("t")).first()
    assert bare.t[0].text is None


# -- 2 language model


def good_turing(counts, k=5):
    """Katz's factors for counts 1 to k from the numbers of n-grams that have each count; 1 above k."""
    n = {r: sum(x == r for x in counts.values()) for r in range(1, k + 2)}

    def factors(n):
        common = (k + 1) * n[k + 1] / n[1]
        if common >= 1:
            return None
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)}
        return d if all(0 < x <= 1 for x in d.values()) else None

    d = factors(n) if all(n.values()) else None
    seen = [r for r in n if n[r]]
    if d is None and len(seen) > 1:  # least squares on logarithms, by hand
        x, y = [math.log(r) for r in seen], [math.log(n[r]) for r in seen]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / sum((a - mx) ** 2 for a in x)
        d = factors({r: math.exp(my + slope * (math.log(r) - mx)) for r in n})
    if d is None:
        off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = {r: (r - off) / r for r in range(1, k + 1)}
    return lambda r: d.get(r, 1.0)


def brute_katz(texts, held, order=2):
    toks = [[*(t or "").encode().translate(LOWER_TABLE).split(), None] for t in texts]
    grams = [None, *(Counter() for _ in range(order))]
    padded = [["<s>"] * (order - 1) + w for w in toks]
    for w, h in zip(padded, held, strict=True):
        if not h:
            for i in range(order - 1, len(w)):
                for n in range(1, order + 1):
                    grams[n][tuple(w[i - n + 1 : i + 1])] += 1
    d = [None, *(good_turing(grams[n]) for n in range(1, order + 1))]
    uni = {g[0]: x for g, x in grams[1].items()}
    total = sum(uni.values())
    unknown = 1 - sum(d[1](x) * x / total for x in uni.values())
    after = [None, None, *(defaultdict(dict) for _ in range(2, order + 1))]
    for n in range(2, order + 1):
        for g, x in grams[n].items():
            after[n][g[:-1]][g[-1]] = x

    @functools.cache
    def backoff(context):
        """How much seen words are scaled by, and the weight of the lower order."""
        own = after[len(context) + 1][context]
        whole = sum(own.values())
        mass = sum(d[len(context) + 1](x) * x / whole for x in own.values())
        scale = 0.999 / mass if mass > 0.999 else 1.0
        return scale, (1 - scale * mass) / (1 - sum(p(context[1:], w) for w in own))

    def p(context, w):
        if not context:
            return d[1](uni[w]) * uni[w] / total if w in uni else unknown
        own = after[len(context) + 1].get(context)
        if own is None:
            return p(context[1:], w)
        scale, weight = backoff(context)
        return scale * d[len(context) + 1](own[w]) * own[w] / sum(own.values()) if w in own else weight * p(context[1:], w)

    scores = [sum(math.log10(p(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w))) for w in padded]
    base = [sum(math.log10((uni.get(x, 0) + 1) / (total + len(uni) + 1)) for x in w) for w in toks]
    for c in [c for n in range(2, order + 1) for c in list(after[n])[:15]]:  # each distribution sums to one
        assert abs(sum(p(c, b) for b in uni) + p(c, "never seen") - 1) < 1e-9
    return scores, base, [len(w) for w in toks], [sum(x in uni for x in w) for w in toks], total


@pytest.mark.parametrize(("order", "part_bytes", "tokens"), [(2, 13 << 20, 5_000_000), (2, 2_000, 700), (3, 2_000, 700), (4, 20_000, 5_000_000)])
def test_katz_against_brute_force(make, odd, monkeypatch, order, part_bytes, tokens):
    monkeypatch.setattr(katz, "PART_BYTES", part_bytes)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [r[:2] for r in odd] + [(1000 + i, " ".join(rng.choices(words, weights=range(60, 0, -1), k=40))) for i in range(80)]
    rows.append(rows[-1])
    held_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    docs = make(rows).withColumn("part", F.lit("theirs")).withColumn("block", F.lit(None))
    out = katz.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order).collect()
    scores, base, n, known, total = brute_katz([r[1] for r in rows], [held_of(r[0]) for r in rows], order)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted([(r[0], held_of(r[0]), x, y, total, b, s) for r, x, y, b, s in zip(rows, n, known, base, scores, strict=True)], key=key)
    assert len(out) == len(want)
    for got, exp in zip(sorted(map(tuple, out), key=key), want, strict=True):
        assert got[:5] == exp[:5]
        assert got[5] == pytest.approx(exp[5], rel=1e-9) and got[6] == pytest.approx(exp[6], rel=1e-9)
    assert katz.score(make(rows).limit(0), F.lit(False), order).count() == 0


def test_katz_without_training_rows(make):
    out = katz.score(make([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in out] == [(True, 0, 0)] * 2 and all(math.isfinite(r.score) for r in out)


# -- 3 personal data


def reference_spans(text):
    e = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    i = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in e.finditer(text)]
    out += [("ip", *m.span()) for m in i.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in c.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in p.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.BASE_KINDS.index(x[0])))


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices("0123456789012345..--@@++ab ( )x%", k=rng.randint(0, 60)))
        text += " 4111 1111 1111 1111 " if rng.random() < 0.3 else ""
        assert reference_spans(text) == [x for x in pii.candidates(text) if x[0] in pii.BASE_KINDS]


def test_pii_over_documents(make, odd):
    key = "".join(random.Random(4).choices("0123456789abcdef", k=40))
    texts = [f'word {i} mail a{i}@host.com or +1 (212) 555-01{i % 90 + 10} from 10.0.0.{i}, token = "{key[i:] + key[:i]}" end' for i in range(30)]
    docs = make([r[:2] for r in odd] + [(2000 + i, t) for i, t in enumerate(texts)])
    model = pii.fit(docs)
    out = rows_of(pii.find(docs, model))
    assert len(out) == docs.count()
    for r in out:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]]
        assert [s for s in spans if s[0] in pii.BASE_KINDS] == reference_spans(r["text"] or "")
        if (r["doc_id"] or 0) >= 2000:
            assert any(s[0] == "secret" for s in spans)
    hidden = rows_of(pii.redact(docs, model))
    assert not any(reference_spans(re.sub(r"\[[A-Z]+\]", " ", r["text"] or "")) for r in hidden)
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def brute_added(text, model):
    """All pairs of candidates and base spans."""
    found = pii.candidates(text)
    base, out, last = [x for x in found if x[0] in pii.BASE_KINDS], [], -1
    for kind, a, b in found:
        if kind in pii.BASE_KINDS or a < last or any(a < y and x < b for _, x, y in base):
            continue
        if model.probability(pii.judge(text, kind, a, b)[1]) >= 0.5:
            out.append((kind, a, b))
            last = b
    return sorted(base + out, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


def test_added_spans_against_all_pairs(make):
    rng = random.Random(14)
    bits = ["a@b.com", "10.0.0.1", "4111 1111 1111 1111", "+1 212 555 0100 22", "212-555-0199", "joe at host dot com", "999.1.2.3", "token=", "0123456789abcdefABCDEF0123456789", " ", " ", "x"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(400)]
    model = pii.fit(make([(i, t) for i, t in enumerate(texts)]))
    assert model.weights and any(x[0] not in pii.BASE_KINDS for t in texts for x in model.spans(t))
    for t in texts:
        assert model.spans(t) == brute_added(t, model)
    # the time of one long text grows with its length
    import time

    took = []
    for n in (4_000, 16_000):
        long = "a@b.com 212-555-0199 x " * n
        start = time.perf_counter()
        assert len(model.spans(long)) >= n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


def test_pii_keeps_columns_of_any_name(make, odd):
    docs = make([r[:2] for r in odd]).withColumn("pii_spans", F.lit("theirs")).withColumn("__text", F.lit("t")).withColumn("kind", F.lit(1))
    model = pii.fit(docs)
    hidden = pii.redact(docs, model)
    assert hidden.schema == docs.schema and {(r.pii_spans, r["__text"], r.kind) for r in hidden.collect()} == {("theirs", "t", 1)}
    found = pii.find(docs, model)
    assert [c for c in found.columns if c != "pii_spans"] == [c for c in docs.columns if c != "pii_spans"] and found.count() == len(odd)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.4
    rates = [0.95, 0.8, 0.65]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in rates], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    p, found = pii.expectation_maximisation(patterns.astype(float), counts.astype(float), 500)
    assert np.abs(found.mean(axis=1) - rates).max() < 0.08
    assert p[(patterns == 1).all(axis=1)][0] > 0.95 and p[(patterns == -1).all(axis=1)][0] < 0.05


# -- 4 mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    free, capped, total = set(names), set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: most * sizes[s] for s in capped}
        free, capped = free - over, capped | over


def test_mix_targets_and_takes(make, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    docs = make(odd)
    out = rows_of(mixing.mix(docs))
    again = rows_of(mixing.mix(docs.repartition(7)))
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(out, key=order) == sorted(again, key=order) and len(out) == len(odd)
    sizes, taken, source = defaultdict(int), defaultdict(int), {r[0]: r[2] for r in odd}
    for d, text, s in odd:
        sizes[s] += len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] >= r["size"] * math.floor(r["target"] / r["source_size"] + 1e-9 if r["source_size"] else 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    per_doc, texts = Counter(), defaultdict(list)
    for r in out:
        per_doc[r["doc_id"]] += r["taken"]
    for d, text, _ in odd:
        texts[d].append(text or "")
    found = Counter()
    for r in rows_of(mixed):
        n = len(WORD.findall(r["text"]))
        assert n and any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        found[r["doc_id"]] += n
    assert found == +per_doc
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_equal_rows_at_the_cut(make):
    """A source of equal rows takes its budget to a word, and the documents hold what the mix takes."""
    rows = [(5, "a b\nc d", "x")] * 40 + [(None, "a", "y")] * 30 + [(i, "e f g", "z") for i in range(100, 140)]
    docs = make(rows).repartition(7)
    out = rows_of(mixing.mix(docs))
    want = brute_targets({"x": 160, "y": 30, "z": 120})
    taken = Counter()
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        taken["x" if r["doc_id"] == 5 else "y" if r["doc_id"] is None else "z"] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want) and len(out) == len(rows)
    mixed = rows_of(mixing.mixed_documents(docs))
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(taken.values())
    assert {r["text"] for r in mixed if r["doc_id"] == 5} <= {"a b\nc d", "a b\nc", "a b", "a"}


def brute_takes(rows, seed=17):
    """Takes of each row by the definition: sort a source by its keys and go through it."""
    sizes, by = defaultdict(int), defaultdict(list)
    for d, text, s in rows:
        t = text or ""
        n = len(WORD.findall(t))
        u = (int(hashlib.md5(f"{seed}:{'' if d is None else d}:{t}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        w = max(0.2, math.exp(-abs(len(t) / max(n, 1) - 6) / 6))
        by[s].append((-math.log(u) / w, d is not None, d or 0, n))
        sizes[s] += n
    target, out = brute_targets(sizes), []
    for s, own in by.items():
        times = int(target[s] / sizes[s] + 1e-12) if sizes[s] else 0
        left = round(target[s] - times * sizes[s])
        for _, known, d, n in sorted(own):
            out.append((d if known else None, n, times * n + min(n, left)))
            left -= min(n, left)
    return out


def test_mix_takes_by_definition(make, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in rows_of(mixing.mix(make(odd))))
    assert got == Counter(brute_takes(odd))


def test_better_documents_come_first(spark, make):
    """Keys are exponential with the weight as rate: the heavier of two is first w1 / (w1 + w2) of the time."""
    rows = [(i, "a b c d e f g h" if i % 2 else "abcdef ghijk") for i in range(4000)]
    keys = {r["doc_id"]: r["key"] for r in rows_of(mixing.documents_with_keys(make(rows)))}
    w = [max(0.2, math.exp(-abs(len(t) / len(t.split()) - 6) / 6)) for t in ("abcdef ghijk", "a b c d e f g h")]
    first = np.mean([keys[i] < keys[i + 1] for i in range(0, 4000, 2)])
    assert abs(first - w[0] / (w[0] + w[1])) < 0.04


# -- 5 packing, 9 token files


def encoded(coder, texts):
    """Ids of each text."""
    ids, at = coder.encode(pa.array([t or "" for t in texts]))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_encoder_is_exact(monkeypatch):
    rng = random.Random(6)
    coder = tokens.Encoder(tokenizer_path, 2)
    bits = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "​", "'s", "'", "1", ".", ",", "é", "<|endoftext|>", "\r", "\xa0", "😀", "\0", "’", " ", "word"]
    library = lambda part: [e.ids for e in coder.tokenizer.encode_batch(part, add_special_tokens=False)]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(6000)]
    for i in range(0, len(texts), 200):
        part = texts[i : i + 200]
        if i == 2000:
            coder.max_pieces = 500
            monkeypatch.setattr(tokens, "SETTLE", 300)
        assert encoded(coder, part) == library(part)
    assert len(coder.old.keys) <= 1500 and len(coder.old.flat) == coder.old.size.sum()
    # a long text is taken in stretches
    monkeypatch.setattr(tokens, "CHUNK", 500)
    long = " ".join("".join(rng.choices(bits, k=30)) for _ in range(2000))
    assert encoded(coder, ["", long, "x", long[:600], ""]) == library(["", long, "x", long[:600], ""])


def test_best_fit_is_the_tightest():
    rng = random.Random(7)
    lengths = sorted((rng.randint(1, 50) for _ in range(400)), reverse=True)
    numbers, places = packing.best_fit_decreasing(lengths, 50)
    left: list[int] = []
    for size, number, place in zip(lengths, numbers, places, strict=True):
        fits = [x for x in left if x >= size]
        if fits:
            assert left[number] == min(fits)
        else:
            assert number == len(left)
            left.append(50)
        assert place == 50 - left[number]
        left[number] -= size


def brute_best_fit(lengths, capacity):
    """How many sequences the rule needs, one piece at a time, and how full they are."""
    left = []
    for size in sorted(lengths, reverse=True):
        fits = [i for i, x in enumerate(left) if x >= size]
        if fits:
            i = min(fits, key=left.__getitem__)
            left[i] -= size
        else:
            left.append(capacity - size)
    return sorted(left)


def test_pack_documents(make, odd):
    """Over several tasks, all pieces are packed together."""
    docs = make(odd).repartition(5).withColumn("ids", F.lit("clash"))
    coder = tokens.Encoder(tokenizer_path, 4)
    out = rows_of(packing.pack(packing.cut(docs, tokenizer_path, length=256), 256))
    texts = sorted((r[1] or "" for r in odd), key=len)
    want = Counter(tuple([*x, 0]) for x in encoded(coder, texts))
    pieces = defaultdict(list)
    for r in out:
        assert zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == 2 * r["length"]
        assert r["piece"] == 0 or r["length"] == 256
        pieces[r["doc_id"], r["piece"], r["start"]].append(r)
    by_doc = defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        by_doc[r["doc_id"]].append(np.frombuffer(r["ids"], "<u2").tolist())
    for doc, ids in [(8, texts[-1])]:
        assert sum(by_doc[doc], []) == [*encoded(coder, [ids])[0], 0]
    assert sum(want.values()) == sum(r["piece"] == 0 for r in out) and sum(map(len, want.elements())) == sum(r["length"] for r in out)
    assert all(r["start"] == sum(x["length"] for x in out if x["doc_id"] == 8 and x["piece"] < r["piece"]) for r in out if r["doc_id"] == 8)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    left = []
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        left.append(256 - at)
    assert sorted(left) == brute_best_fit([r["length"] for r in out], 256)
    assert packing.pack(packing.cut(docs.limit(0), tokenizer_path)).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(71)
    for _ in range(60):
        capacity = rng.choice([5, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 600))]
        lengths += [rng.randint(1, capacity)] * rng.randint(0, 300)
        numbers, places = packing.best_fit_decreasing(sorted(lengths, reverse=True), capacity)
        used = defaultdict(list)
        for size, n, at in zip(sorted(lengths, reverse=True), numbers, places, strict=True):
            used[n].append((at, size))
        for parts in used.values():
            assert all(a + x == b for (a, x), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and min(parts)[0] == 0
        assert sorted(capacity - sum(x for _, x in parts) for parts in used.values()) == brute_best_fit(lengths, capacity)
    # a billion documents of each length take few steps
    steps = packing.plan(dict.fromkeys(range(1, 2048), 10**9 + 7), 2048)
    assert len(steps.rank) < 400_000


def test_pieces_of_one_document_need_not_meet(spark):
    pieces = spark.range(0, 200_000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 1000 == 0, 7).otherwise(64).cast("long").alias("length"))
    out = packing.pack(pieces, 64)
    assert out.select("sequence_id").distinct().count() == 199_800 + -(-200 // 9)
    assert max(r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()) < 100_000


def test_files_of_a_remote_store_are_read_into_memory(monkeypatch):
    from pyarrow import fs

    from chronoloom.llm import files

    store = fs._MockFileSystem()
    monkeypatch.setattr(fs, "FileSystem", types.SimpleNamespace(from_uri=lambda uri: (store, uri.partition("://")[2])))
    for numbers in (np.arange(1000, dtype="<u2"), np.zeros(0, "<u2")):
        files.put("far://set/x.bin", lambda f, numbers=numbers: f.write(numbers.tobytes()))
        assert files.mapped("far://set/x.bin", "<u2").tolist() == numbers.tolist()


def test_token_files(spark, make, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    docs = make(odd)
    folder = token_files.write_token_files(docs, tokenizer_path, 2, folder=f"file://{tmp_path}/set")
    out = rows_of(token_files.read_token_files(spark, folder))
    coder = tokens.Encoder(tokenizer_path, 4)
    order = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for row, found in zip(order, encoded(coder, [r[1] for r in order]), strict=True):
        ids = np.array([*found, 2], "<u4").tobytes()
        got = [r for r in out if r["doc_id"] == row[0] and r["start"] == at]
        assert len(got) == 1 and got[0]["n_tokens"] == len(ids) // 4 and bytes(got[0]["ids"]) == ids
        at += len(ids) // 4
    flat = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "set").glob("*.bin"))])
    assert len(flat) == at and len(out) == len(odd)
    empty = token_files.write_token_files(docs.limit(0), tokenizer_path, 2, folder=f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, empty).count() == 0


# -- 6 quality


def test_quality_counts(make, odd):
    out = rows_of(quality.judge(make(odd)))
    assert len(out) == len(odd)
    key = lambda r: (r[0] is None, r[0] or 0)
    for row, r in zip(sorted(odd, key=key), sorted(out, key=lambda r: key((r["doc_id"],))), strict=True):
        text = row[1] or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count, marked = Counter(grams), set()
        for i, g in enumerate(grams):
            marked |= {i, i + 1, i + 2} if count[g] > 1 else set()
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(marked))
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(marked) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality.judge(make(odd).limit(0)).count() == 0


def test_distance_is_symmetric_and_bounded(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.7, 0.3], [0.2, 0.8])]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    out = df.select(quality.js_distance(F.col("p"), F.col("q")).alias("a"), quality.js_distance(F.col("q"), F.col("p")).alias("b")).collect()
    assert out[0].a == pytest.approx(1) and out[1].a == 0 and all(r.a == pytest.approx(r.b) for r in out)


def test_symbol_noise_is_rejected_and_prose_kept(make):
    rng = random.Random(8)
    words = ["the", "of", "and", "to", "in"] + ["".join(rng.choices("aeinorst", k=6)) for _ in range(300)]
    prose = [(i, " ".join(rng.choices(words, k=120)).capitalize() + ".") for i in range(60)]
    noise = [(100 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in rng.choices(words, k=120))) for i in range(5)]
    out = {r["doc_id"]: r["kept"] for r in rows_of(quality.judge(make(prose + noise)))}
    assert all(out[i] for i, _ in prose) and not any(out[i] for i, _ in noise)


# -- 7, 8 fingerprints and near copies


def brute_components(rows, k, percent=80):
    named = [(d, s) for (d, _), s in zip(rows, shingles.sets([t for _, t in rows], k), strict=True) if d is not None]
    parent = {d: d for d, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            both = len(np.intersect1d(x, y))
            if len(x) and len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d, _ in named}


def near_rows(odd):
    """A text, many edited copies of it that are less like each other than like it, and texts that share a passage."""
    rng = random.Random(9)
    words = [f"t{i}" for i in range(3000)]
    base, passage = rng.choices(words, k=200), rng.choices(words, k=60)
    rows = [r[:2] for r in odd]
    rows.append((500, " ".join(base)))
    for i in range(30):
        own = list(base)
        for j in range(rng.randint(1, 6)):
            own[rng.randrange(200)] = f"new{i}_{j}"
        rows.append((501 + i, " ".join(own)))
    rows += [(600 + i, " ".join(passage + rng.choices(words, k=60))) for i in range(20)]
    return rows


def test_near_copies_against_brute_force(make, odd, monkeypatch):
    from chronoloom.llm import near

    monkeypatch.setattr(near, "BLOCK", 8)
    rows = near_rows(odd)
    want = brute_components(rows, 4)
    docs = make(rows)
    for find in (lambda: dedup.near_duplicates(docs, 4), lambda: near.link(docs, minhash.signatures, 4)):
        out = rows_of(find())
        assert len(out) == len(rows)
        for r in out:
            assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] is not None and want[r["doc_id"]] == r["doc_id"])
    assert dedup.near_duplicates(docs.limit(0), 4).count() == 0


def test_densified_signature_estimates_similarity():
    rng = random.Random(10)
    words = [f"q{i}" for i in range(500)]
    base = rng.choices(words, k=60)
    pairs = [(" ".join(base[i:] + rng.choices(words, k=i)), " ".join(base)) for i in range(0, 60, 3)]
    for k in (dedup, minhash):
        errors = []
        for a, b in pairs:
            x, y = shingles.sets([a, b], 5)
            both = len(np.intersect1d(x, y))
            s = k.signatures([a, b], 5)
            errors.append((s[0] == s[1]).mean() - both / (len(x) + len(y) - both))
        assert abs(np.mean(errors)) < 0.06 and np.abs(errors).max() < 0.2


def plain_signature(text):
    """MinHash by its definition, one shingle and one permutation at a time."""
    numbers = shingles.sets([text], minhash.SHINGLE_WORDS)[0].tolist()
    if not numbers:
        return [0xFFFF] * minhash.PERMUTATIONS
    a, b = (x.tolist() for x in minhash._permutations())
    out = []
    for i in range(minhash.PERMUTATIONS):
        least = min(((n >> 32) * a[i] + b[i]) % (1 << 32) for n in numbers)
        out.append(int(shingles.mixed(np.array([least], np.uint64))[0]) >> 48)
    return out


def test_edited_neighbours(make, odd, monkeypatch):
    monkeypatch.setattr(minhash, "TASK_BYTES", 20_000)
    monkeypatch.setattr(minhash, "_CHARS", 3000)
    rows = [*[r[:2] for r in odd], (None, "again"), (5, "another text of the same id"), (8, None)]
    docs = make(rows).withColumn("range", F.lit("theirs")).withColumn("copy", F.lit(7))
    out = rows_of(minhash.edited_neighbours(docs))
    assert len(out) == len(rows)
    tie = {r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).distinct().withColumn("h", F.xxhash64("t")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1] or ""]))
    texts = [t or "" for _, t in order]
    plain = functools.cache(plain_signature)
    alike = lambda x, y: sum(p == q for p, q in zip(plain(x), plain(y), strict=True)) / minhash.PERMUTATIONS
    digits = lambda t: b"".join(x.to_bytes(2, "little") for x in plain(t)).hex()
    want = []
    for (d, _), own, after in zip(order, texts, texts[1:] + texts[:1], strict=True):
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        want.append((d, len(own), hashlib.sha256(edited.encode()).hexdigest(), digits(own), digits(edited), alike(own, edited), alike(own, after)))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r[c] for c in columns) for r in out), key=repr) == sorted(want, key=repr)
    prints = {r["doc_id"]: r["fingerprint"] for r in out if r["doc_id"] in (6, 7)}
    assert prints[6] != prints[7] and prints[6] in {r["fingerprint"] for r in out if r["doc_id"] == 5}
    assert sorted((r["doc_id"] or 0, r["fingerprint"]) for r in rows_of(minhash.fingerprint(docs))) == sorted((r["doc_id"] or 0, r["fingerprint"]) for r in out)
    assert minhash.edited_neighbours(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "every"), [(512, 1), (4, 1), (4, 5)])
def test_nearest_against_brute_force(make, odd, monkeypatch, block, every):
    """Every document that asks gets the most similar of all others, copies and several texts of an id included."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHARES", 4)
    near = near_rows(odd)
    text = dict(near)
    rows = [*near, *((700 + i, "the same words again in each of these texts") for i in range(40))]
    # edited copies of edited copies: near each other, less near the text they come from
    rows += [(800 + i, text[501 + i % 30].replace(f"new{i % 30}_0", f"other{i}")) for i in range(60)]
    rows += [(900, text[505]), (900, text[600]), (901, text[600]), (901, text[601]), (895, text[602]), (895, "one more"), (902, text[603] + " one more")]
    out = {r["doc_id"]: (r["near_id"], r["near_jaccard"]) for r in rows_of(minhash.nearest(make(rows), every))}
    own = defaultdict(list)
    for (d, _), s in zip(rows, shingles.sets([t for _, t in rows], 5), strict=True):
        if d is not None and len(s):
            own[d].append(set(s.tolist()))
    want = {}
    for d in own:
        alike = ((len(x & y) / len(x | y), -e) for e in own if e != d for x in own[d] for y in own[e] if 100 * len(x & y) >= 80 * len(x | y))
        if d % every == 0 and (best := max(alike, default=None)):
            want[d] = (-best[1], pytest.approx(best[0]))
    assert out == want and len(want) > 100 / every
    assert minhash.nearest(make(rows).limit(0)).count() == 0


def test_last_turn_compares_whole_shingles(spark):
    from chronoloom.llm import near

    high = 1 << 31
    sets_of = {
        # 8 of 10 shared, two of them equal in their low 31 bits
        (1, 1): [1, 2, 3, 4, 5, 6, 9, 9 + high, 20],
        (1, 2): [1, 2, 3, 4, 5, 6, 9, 9 + high, 30],
        # 11 and 13 are near 12, but look near each other only in their low bits
        (2, 11): [*range(1, 19), 50 + (high << 1)],
        (2, 12): [*range(1, 21)],
        (2, 13): [*range(3, 21), 50 + (high << 2)],
    }
    members = spark.createDataFrame([(key, 0, i, 1, 0, i) for key, i in sets_of], "key long, band int, id long, blocks int, block int, component long")
    classes = spark.createDataFrame([(i, [key]) for key, i in sets_of], "id long, bands array<long>")
    known = spark.createDataFrame([(i, x) for (_, i), x in sets_of.items()], "id long, shingles array<long>")
    assert sorted(map(tuple, near._across(members, classes, known, 80).collect())) == [(1, 2), (11, 12), (12, 13)]


# -- 10 toxicity


def test_maximal_segments_against_definition():
    rng = random.Random(11)

    def brute(w, lo, hi):
        best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return brute(w, lo, best[2]) + [best[2:4]] + brute(w, best[3], hi)

    for _ in range(300):
        w = [rng.gauss(-0.3, 1) for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in toxicity.maximal_segments(np.array(w))] == brute(w, 0, len(w))


def test_toxic_documents_are_found_on_held_out_rows(spark, make):
    rng = random.Random(12)
    words = ["".join(rng.choices("aeinorst", k=5)) for _ in range(500)]
    rows, labels = [(None, None), (-1, "")], []
    for i in range(600):
        text = rng.choices(words, k=80)
        if bad := i % 5 == 0:
            for _ in range(6):
                text[rng.randrange(80)] = rng.choice(["idiot,", "Moron", "scum!"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = make(rows), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    held = F.col("doc_id") % 3 == 0
    model = toxicity.fit(docs, marks, held)
    out = {r["doc_id"]: r for r in rows_of(toxicity.score(docs, model))}
    right = [(out[i]["toxic_score"] >= 0.5) == bool(t) for i, t in labels if i % 3 == 0]
    assert len(out) == 602 and np.mean(right) > 0.97 and all(0 <= r["toxic_score"] <= 1 for r in out.values())
    assert toxicity.score(docs, toxicity.fit(docs, marks.limit(0), held)).count() == 602
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_all_tokens_of_toxic_documents_are_kept(spark, make):
    letters = "abcdefghijklmnop"
    words = ["".join(letters[i >> s & 15] for s in (12, 8, 4, 0)) for i in range(60_000)]
    neutral, rare = words[:55_000], words[55_000:]
    # neutral words stand in more toxic documents than the rare ones, which no clean document has
    rows = [(i, " ".join(neutral)) for i in range(4)] + [(i, " ".join(rare)) for i in (4, 5, 6)] + [(7 + i, " ".join(neutral)) for i in range(7)]
    marks = spark.createDataFrame([(i, int(i < 7)) for i in range(14)], "doc_id long, toxic int")
    model = toxicity.fit(make(rows), marks, F.lit(False))
    assert set(model.known.tolist()) == set(toxicity.tokens(words)[0].tolist())
    assert model.weights(toxicity.tokens(rare)[0]).min() > model.weights(toxicity.tokens(neutral)[0]).max()


def brute_scores(rows, labels, held):
    """The model by its definition, token by token: weights with a Dirichlet prior, E-values, curve."""
    split = lambda t: [w for w in re.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "") if w]
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in split(t)]
    train = [(low(t), labels[d]) for d, t in rows if d in labels and not held(d)]
    docs, count = len(train), {0: Counter(), 1: Counter()}
    for words, kind in train:
        count[kind].update(set(words))
    total = {k: sum(c.values()) for k, c in count.items()}
    share = toxicity.PRIOR_DOCS / docs
    types = len(count[0] | count[1]) + 1
    prior_mass = toxicity.PSEUDO * types + share * (total[0] + total[1])

    def weight(w, kind=None):
        t, c = count[1][w] - (kind == 1), count[0][w] - (kind == 0)
        if t <= 0:
            return -toxicity.DRIFT
        c = max(c, 0)
        a = toxicity.PSEUDO + share * (t + c)
        lo, hi = toxicity.WEIGHT_RANGE
        return min(hi, max(lo, math.log((t + a) / (total[1] + prior_mass - t - a)) - math.log((c + a) / (total[0] + prior_mass - c - a)))) - toxicity.DRIFT

    def segments(w, lo, hi):
        best = max(((sum(w[i:j]), -(j - i), i, j) for i in range(lo, hi) if w[i] > 0 for j in range(i + 1, hi + 1) if w[j - 1] > 0), default=(0, 0, 0, 0))
        return [] if best[0] <= 0 else [*segments(w, lo, best[2]), best[0], *segments(w, best[3], hi)]

    sums = lambda words, kind=None: segments([weight(x, kind) for x in words], 0, len(words))
    clean = [w for w, kind in train if not kind and w]
    hist = Counter(round(weight(x, 0), 1) for w in clean for x in w)
    n = sum(hist.values())
    lo, hi = 1e-3, 64.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(m / n * math.exp(mid * w) for w, m in hist.items()) < 1 else (lo, mid)
    k = math.exp(lo * np.mean([max(sums(w, 0), default=0.0) for w in clean]) - np.mean([math.log(len(w)) for w in clean]) - 0.5772156649)
    e_values = lambda words, kind=None: [e for s in sums(words, kind) if (e := k * len(words) * math.exp(-lo * s)) < toxicity.MAX_E]
    evidence = lambda words, kind=None: math.log1p(sum(-math.log10(e) for e in e_values(words, kind)))
    x = np.array([0.1 * round(evidence(w, kind) / 0.1) for w, kind in train])
    y = np.array([float(kind) for _, kind in train])
    beta = np.zeros(2)
    for _ in range(4000):  # a plain ascent with halved steps, to the same optimum
        z = beta[0] + beta[1] * x
        p = 1 / (1 + np.exp(-z))
        g = np.array([(y - p).sum(), ((y - p) * x).sum()]) - 1e-3 * beta
        h = np.array([[(p * (1 - p)).sum() + 1e-3, (p * (1 - p) * x).sum()], [0, (p * (1 - p) * x * x).sum() + 1e-3]])
        h[1, 0] = h[0, 1]
        beta += 0.2 * np.clip(np.linalg.solve(h, g), -2, 2)
    return {d: 1 / (1 + math.exp(-(beta[0] + beta[1] * evidence(low(t))))) for d, t in rows}


def test_toxicity_against_brute_force(spark, make):
    rng = random.Random(13)
    words = ["".join(rng.choices("aeinorst", k=3)) for _ in range(60)]
    rows, labels = [(900, None), (901, ""), (902, "é1É 77 x")], {}
    for i in range(120):
        text = rng.choices(words, k=rng.randint(0, 25))
        bad = i % 3 == 0
        for _ in range(3 if bad else rng.random() < 0.1):
            text.insert(rng.randint(0, len(text)), rng.choice(["Idiot", "moron!", "scüm,"]))
        rows.append((i, rng.choice([" ", "-"]).join(text)))
        if i % 7:
            labels[i] = int(bad)
    rows += [(200, rows[5][1]), (201, "moron " * 40)]
    # every row twice over in the table's extra columns: names of results among them
    docs = make(rows).withColumn("toxic_score", F.lit(7.0)).withColumn("Toxic_passages", F.lit("theirs")).withColumn("token", F.lit(1)).repartition(3)
    marks = spark.createDataFrame([*labels.items()], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 == 0)
    want = brute_scores(rows, labels, lambda d: d % 5 == 0)
    out = rows_of(toxicity.score(docs, model))
    assert len(out) == len(rows) and all(r["toxic_score"] == pytest.approx(want[r["doc_id"]], abs=2e-3) for r in out)
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns
    got = rows_of(kept)
    assert {r["doc_id"] for r in got} == {d for d, p in want.items() if p < 0.5} and all(r["toxic_score"] == 7.0 and r["Toxic_passages"] == "theirs" for r in got)
    twice = docs.unionByName(docs)
    assert toxicity.score(twice, toxicity.fit(twice, marks, F.lit(False))).count() == 2 * len(rows)
    assert toxicity.clean(docs.limit(0), toxicity.fit(docs.limit(0), marks, F.lit(False))).count() == 0
