"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered ``<|im_start|>`` role LF text ``<|im_end|>`` LF.  The parser is deterministic: it cuts at every
start mark, reads the role up to the first line feed and the text up to the first end mark, and takes one backslash
out of each ``<`` backslashes ``|``.  Each turn is first rendered as it is and parsed again; where the parse differs
from the source (the text holds a mark, or something the parser would unescape) every ``<|`` in it, and every ``<``
backslashes ``|``, gets one backslash more, which the parser takes out again.  The whole conversation is parsed once
more, and a difference that is left raises an error.

In roles ``%``, ``<`` and line feeds are percent-encoded.  Defined cases: null role or text: empty; null or equal
turns sort by (turn, role, text), nulls first; rows with a null conv_id are one conversation; repeated rows are turns
of their own; an empty table gives no conversation.  A conversation is one string, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def encode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def decode_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), encode_role(role), F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered string."""
    pieces = F.split(rendered, r"<\|im_start\|>", -1)
    pieces = F.filter(pieces, lambda p, i: i > 0)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.char_length(head) + 2, F.char_length(p))
        return F.struct(decode_role(head).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"))

    return F.transform(pieces, turn)


def format_conversations(rows: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, turns (parsed back), escaped (turns that were), loss_spans (start, length in code points)."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("source"))
    same = lambda t: parse(render(t["role"], t["text"])) == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text")))
    shown = F.transform("source", lambda t: F.struct(t["role"].alias("role"), F.when(same(t), t["text"]).otherwise(escape(t["text"])).alias("shown"), t["text"].alias("text")))
    conv = conv.select("conv_id", shown.alias("source"))
    conv = conv.withColumn("formatted", F.array_join(F.transform("source", lambda t: render(t["role"], t["shown"])), ""))
    conv = conv.withColumn("turns", parse(F.col("formatted")))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(F.col("turns") == wanted, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.lit(len(START) + 1) + F.char_length(encode_role(t["role"]))
        size = F.char_length(t["shown"])
        span = F.array(F.struct((acc["at"] + head).cast("bigint").alias("start"), size.cast("bigint").alias("length")))
        return F.struct((acc["at"] + head + size + F.lit(len(END) + 1)).cast("bigint").alias("at"), F.when(t["role"] == trained_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("source", begin, step, lambda acc: acc["spans"])
    escaped = F.size(F.filter("source", lambda t: t["shown"] != t["text"]))
    return conv.select("conv_id", "formatted", checked.alias("turns"), escaped.alias("escaped"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
