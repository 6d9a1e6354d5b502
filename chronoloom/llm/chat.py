"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

``<|im_start|>``, ``<|im_end|>``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``
are control strings; none may stand inside a rendered text, and the parser
reads no text from a turn that has one.  A text is rendered verbatim first and
read back; if the parser doesn't return the source, the text is escaped: each
control string, and each control string with backslashes after its bracket,
gets one more backslash there.  The parser takes one away, so that escaping is
exactly reversible.  The whole conversation is parsed once more and compared
with its source; where it differs, all of its texts are escaped and it is
parsed again, and what still differs is an error.  Roles are percent-encoded
where they would break a header.

Nulls: a null role or text counts as empty; a null turn number sorts first; a
null conversation id is a conversation of its own.  Turns with equal numbers
are ordered by role, then text.  Empty tables give empty results; other columns
are ignored.  A conversation is one value of the result, so it has to fit into
a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_REST = r"(?=/?s>|/?INST\]|\|im_start\|>|\|im_end\|>)"
_OPEN = r"([<\[])(\\*)"
#: A role's characters that a header can't hold, "%" first.
_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + _REST, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\" + _REST, "$1$2")


def _encode_role(role: Column) -> Column:
    for char, code in _ROLE_CODES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def _decode_role(role: Column) -> Column:
    for char, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _encode_role(role), F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text); a null text where a control string stands in it."""
    head = len(START)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        text = F.substring(piece, line + 1, F.length(piece))
        return F.struct(
            _decode_role(F.substring(piece, F.lit(head + 1), line - F.lit(head + 1))).alias("role"),
            F.when(~text.rlike(r"[<\[]" + _REST), unescape(text)).alias("text"),
        )

    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def _reads_back(rendered: Column, source: Column) -> Column:
    return F.coalesce(parse(rendered) == source, F.lit(False))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask, n_turns, n_escaped).

    ``loss_mask`` lists the half-open code point spans of the trained texts,
    as rendered; the parser returns the source of every row.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("verbatim", _reads_back(_turn(F.col("role"), F.col("text")), F.array(F.struct("role", "text"))))
    forms = []
    # texts escaped where their own turn needs it, and all texts escaped
    for name, body in (("one", F.when(F.col("verbatim"), F.col("text")).otherwise(escape(F.col("text")))), ("all", escape(F.col("text")))):
        rows = rows.withColumn(f"body_{name}", body)
        segment = _turn(F.col("role"), F.col(f"body_{name}"))
        at = F.coalesce(F.sum(F.length(segment).cast("long")).over(before), F.lit(0))
        begin = at + F.lit(len(START) + 1) + F.length(_encode_role(F.col("role")))
        rows = rows.withColumn(f"start_{name}", begin)
        forms.append(F.struct(F.col(f"body_{name}").alias("body"), F.col(f"start_{name}").alias("start")).alias(name))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "role", "text", "verbatim", *forms))).alias("t"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = lambda form: F.array_join(F.transform("t", lambda x: _turn(x["role"], x[form]["body"])), "")
    chats = chats.select("conv_id", "t", source.alias("source"), whole("one").alias("first"))
    chats = chats.withColumn("settled", _reads_back(F.col("first"), F.col("source")))
    chats = chats.withColumn("formatted", F.when(F.col("settled"), F.col("first")).otherwise(whole("all")))
    failed = F.raise_error(F.concat(F.lit("a conversation doesn't read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    sure = F.when(F.col("settled") | _reads_back(F.col("formatted"), F.col("source")), F.col("formatted")).otherwise(failed)
    form = lambda x: F.when(F.col("settled"), x["one"]).otherwise(x["all"])
    span = lambda x: F.struct(form(x)["start"].alias("start"), (form(x)["start"] + F.length(form(x)["body"])).alias("stop"))
    return chats.select(
        "conv_id",
        sure.alias("formatted"),
        F.transform(F.filter("t", lambda x: x["role"] == TRAINED_ROLE), span).alias("loss_mask"),
        F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: form(x)["body"] != x["text"])).cast("long").alias("n_escaped"),
    )


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    part = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return F.array_join(F.transform(mask, part), "")
