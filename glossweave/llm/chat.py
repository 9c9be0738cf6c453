"""Chat formatting with Spark expressions only.

Turns are collected per conversation and sorted, adjacent turns of one role are merged into one
block (their texts stay apart by a separator mark, so the merge can be undone), and blocks are
joined. Control strings inside roles and texts get a backslash after their first character, so
a mark in the output is always a mark of the template, and reading back restores every text.

Defined results: a null text or role is empty; a null turn sorts first; ties on turn sort by role
and text; repeated rows are repeated turns; null conversation ids form one conversation; an empty
table gives an empty table; other columns are not read. A conversation is one output row and
must fit in memory as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, CLOSE = "<|im_start|>", "<|im_text|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that are never left as they are in a text: the template's own marks and common ones.
#: Each starts with a character that occurs in none of them again, so matches never overlap.
_TAILS = r"(\|im_start\|>|\|im_text\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + _TAILS, "$1$2$3")


def _quote(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``mask``, the loss mask in runs: (chars, loss) for each piece of ``formatted`` in order, chars in code points."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(F.col(conv).alias(conv), F.struct(F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")).alias("t"))
    turns = turns.groupBy(conv).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    t, n = F.col("turns"), F.size("turns")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(t, i - 1)["role"] != F.get(t, i - 2)["role"]))
    turns = turns.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(n + 1))
    blocks = F.transform(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b")), lambda x: F.slice(t, x["a"], x["b"] - x["a"]))
    turns = turns.withColumn("blocks", blocks)

    def render(block: Column) -> Column:
        loss = F.get(block, F.lit(0))["role"] == learn
        head = F.concat(F.lit(OPEN), escape(F.get(block, F.lit(0))["role"]), F.lit(BODY))
        part = lambda s, on: F.struct(s.alias("text"), on.alias("loss"))
        inner = F.flatten(F.transform(block, lambda x, i: F.array(part(F.when(i == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), part(escape(x["text"]), loss))))
        return F.concat(inner, F.array(part(F.lit(CLOSE), F.lit(False))))

    out = turns.withColumn("pieces", F.flatten(F.transform("blocks", render)))
    mask = F.transform("pieces", lambda x: F.struct(F.char_length(x["text"]).alias("chars"), x["loss"].alias("loss")))
    return out.select(conv, F.array_join(F.col("pieces.text"), "").alias("formatted"), mask.alias("mask"))


def _blocks(formatted: Column) -> Column:
    """The blocks of a formatted conversation: array of (role, body), the role unescaped."""
    blocks = F.split(formatted, _quote(CLOSE))
    parts = F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda block: F.split(block, _quote(BODY)))
    role = lambda x: unescape(F.substring(F.get(x, F.lit(0)), len(OPEN) + 1, 1 << 30))
    return F.transform(parts, lambda x: F.struct(role(x).alias("role"), F.get(x, F.lit(1)).alias("body")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order: array of (role, text)."""
    return F.flatten(F.transform(_blocks(formatted), lambda b: F.transform(F.split(b["body"], _quote(NEXT)), lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))


def masked_text(formatted: Column, learn: str = "assistant") -> Column:
    """All text of ``formatted`` under the loss mask, unescaped, in order, with nothing between: the bodies of the learned
    role's blocks without the marks inside. Read in one pass over ``formatted``."""
    learned = F.filter(_blocks(formatted), lambda b: b["role"] == learn)
    return F.array_join(F.flatten(F.transform(learned, lambda b: F.transform(F.split(b["body"], _quote(NEXT)), unescape))), "")
