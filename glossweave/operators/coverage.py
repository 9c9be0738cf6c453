"""Which records an existing patch covers, and what is left: lookups, staleness, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .overlay import first_rows

OWN_PREFIX = "SJPTS_"


def match_key(record_type: Column, form: Column, index: Column, editor_id: Column, text: Column) -> Column:
    """The key by which a record of this type is matched: one string, so that three strategies are one join."""
    return (
        F.when(record_type == "GMST DATA", F.concat_ws("\u0001", F.lit("E"), record_type, F.lower(editor_id)))
        .when(record_type == "QUST CNAM", F.concat_ws("\u0001", F.lit("T"), record_type, form, text))
        .otherwise(F.concat_ws("\u0001", F.lit("I"), record_type, form, index.cast("string")))
    )


def lookup(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Left join of records (record_type, form_id, index, editor_id, text) with entries (type, form_id, index,
    editor_id, original, string, status, entry_no); the first entry of a key counts. Adds ``covered`` (struct)."""
    keyed = entries.withColumn("_k", match_key(F.col("type"), F.col("form_id"), F.col("index"), F.col("editor_id"), F.col("original")))
    first = keyed.groupBy("_k").agg(F.min_by(F.struct("original", "string", "status"), "entry_no").alias("covered"))
    left = records.withColumn("_k", match_key(F.col("record_type"), F.col("form_id"), F.col("index"), F.col("editor_id"), F.col("text")))
    return left.join(first, "_k", "left").drop("_k")


def judge(found: DataFrame) -> DataFrame:
    """Add ``own`` (decided by this tool: any language counts), ``is_covered`` and ``is_stale`` to looked-up records."""
    c = F.col("covered")
    own = F.coalesce(c["status"].startswith(OWN_PREFIX), F.lit(False))
    covered = F.coalesce(own | X.contains_japanese(c["string"]), F.lit(False)) & c.isNotNull()
    changed = (F.coalesce(c["original"], F.lit("")) != "") & (X.trim(c["original"]) != X.trim(F.col("text")))
    return found.withColumn("own", own).withColumn("is_covered", covered).withColumn("is_stale", covered & ~own & changed)


def roll_up(rows: DataFrame, covered: Column, candidate: Column, plugin: str, text: str, order: str) -> DataFrame:
    """Coverage per plugin (case ignored) in one pass over the rows.

    As the source counts, a row that is both covered and a candidate counts on both sides; pass
    disjoint conditions for a strict count. Counts are first made per spelling of the plugin, so that they
    are fixed-width hash aggregates; spellings are merged afterwards, one row each.
    """
    chars = lambda on: F.sum(F.when(on, F.char_length(text)).otherwise(0)).cast("long")
    per = rows.groupBy(plugin).agg(F.count_if(covered).alias("translated"), F.count_if(candidate).alias("untranslated"), chars(covered).alias("translated_chars"), chars(candidate).alias("untranslated_chars"))
    per = per.where("translated + untranslated > 0").withColumn("k", F.lower(plugin))
    sums = ["translated", "untranslated", "translated_chars", "untranslated_chars"]
    out = per.groupBy("k").agg(F.min(plugin).alias("plugin"), *[F.sum(c).alias(c) for c in sums])
    # samples: the three least candidate rows of a plugin, pruned before the shuffle
    least = first_rows(rows.where(candidate).select(F.lower(plugin).alias("k"), order, text), ["k"], [F.asc(order), F.asc(text)], 3)
    sample = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: X.preview(s[text])), " / ")
    out = out.join(least.groupBy("k").agg(sample.alias("sample")), "k", "left").select("plugin", *sums, F.coalesce("sample", F.lit("")).alias("sample"))
    total = F.col("translated") + F.col("untranslated")
    all_chars = F.col("translated_chars") + F.col("untranslated_chars")
    return out.withColumn("total", total).withColumn("ratio", F.round(X.percent(F.col("translated"), total), 6)).withColumn("chars_ratio", F.round(X.percent(F.col("translated_chars"), all_chars), 6))
