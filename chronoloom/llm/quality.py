"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated 3-word windows.
The method adds two histograms for each document, of character classes and of
common words, and compares them with the references of the document's language
by the Jensen-Shannon distance.  A reference is the mean histogram over all
documents of that language that pass the base rules, so it covers the whole
table, and each document weighs the same in it.  Texts below a minimum length
are not judged by a histogram, as theirs are mostly noise.

Texts are read once; what is counted goes to a written table of a few dozen
numbers for each document, from which references and distances come.

Nulls: a null text has no words and fails the base rules; documents with a null
language share one reference.  Repeated ids and rows are judged row by row;
nothing depends on ties.  Texts of any length are read whole.  Empty tables
give empty results, other columns are ignored, whatever their names.  Windows
are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, written

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Frequent function words of the four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "nicht", "ein"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
#: Character classes; what is in none of them is the last class.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": SPACE, "stop": r"[.,;:!?'\x22()-]", "symbol": r"[#*$%&|<>{}\[\]\\/@^_~=+`]"}
#: Distances above these are rejected; guards in characters and words.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.50
MIN_CLASS_CHARS, MIN_HIST_WORDS = 200, 100


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that the text has twice or more."""
    n_windows = F.size(words) - 2

    def marked(g: Column) -> Column:
        # A window's hash above, its place below, so that one sort of plain numbers brings equal windows together.
        bits = F.ceil(F.log2(F.size(g) + F.lit(2))).cast("int")
        packed = F.sort_array(F.transform(g, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        at = lambda s, j: F.get(g, F.get(s, j).bitwiseAND(mask).cast("int"))
        places = let(
            packed,
            lambda s: F.filter(
                F.transform(s, lambda x, j: F.when((at(s, j) == at(s, j + 1)) | (at(s, j) == at(s, j - 1)), x.bitwiseAND(mask))),
                lambda p: p.isNotNull(),
            ),
        )
        return let(F.sort_array(places), lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]))

    windows = F.transform(F.sequence(F.lit(0), n_windows - 1), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    counted = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(marked(g)))
    return F.when(n_windows >= 2, counted).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, base counts and both histograms as counts."""
    common = sorted({w for words in COMMON_WORDS.values() for w in words})
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda t, p: F.regexp_count(t, F.lit(p)).cast("long")

    def of_chars(t: Column) -> Column:
        """Lower letters go first, in runs; what is left is short, and holds all that the other patterns count."""
        n = F.length(t).cast("long")
        rest = lambda r: F.struct(
            F.array(n - F.length(r), *[count(r, p) for name, p in CLASSES.items() if name != "lower"]).alias("class_hist"), count(r, "[#*$%&|<>]").alias("n_symbols"), n.alias("n_chars")
        )
        return let(F.regexp_replace(t, "[a-z]+", ""), rest)

    def of_words(w: Column) -> Column:
        known = F.filter(F.transform(w, lambda x: F.lower(x)), lambda x: x.isin(common))
        hist = let(known, lambda k: F.array(*[(F.size(k) - F.size(F.array_remove(k, c))).cast("long") for c in common]))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), hist.alias("word_hist"))

    rows = docs.select("doc_id", "lang", text.alias("text"))
    rows = rows.select(
        "doc_id",
        "lang",
        of_chars(F.col("text")).alias("c"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), of_words).alias("w"),
    ).select("doc_id", "lang", "c.*", "n_dup_lines", "w")
    space = list(CLASSES).index("space")
    rows = rows.select(
        "doc_id", "lang", "n_chars", "class_hist", "n_symbols", "n_dup_lines", "w.n_words", "w.n_repeat_words", "w.word_hist",
        (F.col("n_chars") - F.col("class_hist")[space]).alias("word_chars"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _shares(hist: Column, total: Column) -> Column:
    """A histogram's shares of the total, what it doesn't count last."""
    rest = total - F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(hist, F.array(rest)), lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2: from 0 to 1."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda x, y: (half(x, y) + half(y, x)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, both distances, base_failed and kept for each row of ``docs``."""
    n_common = len({w for words in COMMON_WORDS.values() for w in words})
    rows = written(measures(docs), "measures")
    rows = rows.withColumn("p_class", _shares(F.col("class_hist"), F.col("n_chars"))).withColumn("p_word", _shares(F.col("word_hist"), F.col("n_words")))
    mean = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)])
    references = rows.where(~F.col("base_failed")).groupBy(F.col("lang").alias("__lang")).agg(
        mean("p_class", len(CLASSES) + 1).alias("q_class"), mean("p_word", n_common + 1).alias("q_word")
    )
    rows = rows.join(references, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    distance = lambda p, q, ok: F.when(ok & F.col(q).isNotNull(), js_distance(F.col(p), F.col(q)))
    rows = rows.withColumn("class_distance", distance("p_class", "q_class", F.col("n_chars") >= MIN_CLASS_CHARS))
    rows = rows.withColumn("word_distance", distance("p_word", "q_word", F.col("n_words") >= MIN_HIST_WORDS))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance",
    )
