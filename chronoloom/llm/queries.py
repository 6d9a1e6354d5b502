"""Queries over the tables of a folder, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dedup, katz, minhash, mixing, packing, pii, quality, token_files, toxicity
from .common import read

#: A conversation whose texts hold the control strings of usual templates.
HARD_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(hard))
    back = chats.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(read(spark, sf_dir, "documents"), held_out=_remainder("doc_id", 7) == 2)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    return found.select(
        "doc_id", *[pii.of_kind(k).alias(f"n_{k}") for k in pii.BASE_KINDS], F.sha2(pii.joined(base_only=True), 256).alias("base_sha256"), pii.joined().alias("spans")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, length=2048, ids=False, ranked=True)
    return packing.pack_ranked(pieces, length=2048)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_neighbours(read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _remainder(column: str, divisor: int):
    """crc32 of an id as text modulo a number."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels, held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_lm_score": op2_lm_score,
    "op3_pii": op3_pii,
    "op4_mix_sources": op4_mix_sources,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_quality_rules": op6_quality_rules,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"



def _quality_sql() -> str:
    """Every count, reference and distance of the quality rules."""
    word = r"[^\x20\x09-\x0D]"
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    classes = ", ".join(f"len(regexp_extract_all(t, {quote(p)}))" for p in quality.CLASSES.values())
    common = "[" + ", ".join(map(quote, sorted({w for words in quality.COMMON_WORDS.values() for w in words}))) + "]"
    shares = lambda h, n: f"list_transform(list_append({h}, {n} - list_sum({h})), lambda x: CASE WHEN {n} > 0 THEN x / {n} ELSE 0.0 END)"
    mean = lambda p, n: "[" + ", ".join(f"avg({p}[{i + 1}])" for i in range(n + 1)) + "]"
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    distance = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')}) / 2))))"
    n_common = len({w for words in quality.COMMON_WORDS.values() for w in words})
    space = list(quality.CLASSES).index("space") + 1
    return f"""
WITH m AS (SELECT doc_id, lang, length(t) AS n_chars, [{classes}] AS ch, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines, regexp_extract_all(t, '{word}+') AS w
    FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM m)),
d AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g SEMI JOIN (SELECT doc_id, x FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, x)),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM d GROUP BY 1),
c AS (SELECT m.*, len(w) AS n_words, coalesce(r.n, 0) AS n_repeat_words, list_transform({common}, lambda c: len(list_filter(w, lambda x: lower(x) = c))) AS wh FROM m LEFT JOIN r USING (doc_id)),
p AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed, {shares("ch", "n_chars")} AS pc, {shares("wh", "n_words")} AS pw FROM c),
q AS (SELECT lang, {mean("pc", len(quality.CLASSES))} AS qc, {mean("pw", n_common)} AS qw FROM p WHERE NOT base_failed GROUP BY 1),
j AS (SELECT p.*, CASE WHEN n_chars >= {quality.MIN_CLASS_CHARS} AND qc IS NOT NULL THEN {distance("pc", "qc")} END AS dc, CASE WHEN n_words >= {quality.MIN_HIST_WORDS} AND qw IS NOT NULL THEN {distance("pw", "qw")} END AS dw FROM p LEFT JOIN q ON p.lang IS NOT DISTINCT FROM q.lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - ch[{space}] AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(dc, 0) > {quality.MAX_CLASS_DISTANCE} OR coalesce(dw, 0) > {quality.MAX_WORD_DISTANCE}) AS kept,
    round(dc, 6) AS class_distance, round(dw, 6) AS word_distance FROM j"""


ORACLE_SQL: dict[str, str] = {
    # each source sorted by its keys as a whole; the level of targets as in water filling
    "op4_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT doc_id, source, size,
    -ln((CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / greatest(0.2, exp(-abs(length(t) / greatest(size, 1) - 6.0) / 6.0)) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
x AS (SELECT *, row_number() OVER o AS rank, (sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS own FROM w
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST), r AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(own, rank) FROM x WHERE own * weight <= cap)), cap) AS target FROM x),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM p)
SELECT k.doc_id, k.size, e.source_size, e.target, CAST(epochs * size + greatest(0, least(size, greatest(0, round(target - epochs * source_size)) - coalesce(
    sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source""",
    "op6_quality_rules": _quality_sql(),
    # a control string gets one more backslash after its bracket; a turn adds its two marks and the line feed of its role
    "op1_chat_format": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>)', '\1\2\\\3', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + length(escaped) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op8_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id, n.doc_id = least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS kept
FROM n LEFT JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
}
