"""The resolution cascade: the first method that has an answer decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import checkpoint
from . import mining, names
from . import spelling as spelling_ops

# --- Fixed values: method tags and their trust as hints, most trusted first -------------------
TRUST = ["SJPTS_ModifiedByUser", "SJPTS_AutoCorpusMeaning", "SJPTS_AutoCorpusMeaningTranslit", "SJPTS_AutoCorpusTransliterate", "SJPTS_AutoCrossModPrecedent", "SJPTS_TranslationCloudLlm", "SJPTS_TranslationLocalLlm", "SJPTS_TranslationNameFallback"]
BUCKETS = {"exact": "SJPTS_AutoCorpus(Dsd|Imported|ReferenceTaiyaku|Override)?$", "meaning": "SJPTS_AutoCorpusMeaning", "transliteration": "SJPTS_AutoCorpusTransliterate$", "cross_mod": "SJPTS_AutoCrossModPrecedent$", "fallback": "SJPTS_TranslationNameFallback$", "llm": "SJPTS_Translation(Local|Cloud)Llm"}
PROPOSED, OVERRIDE = "SJPTS_TranslationProposed", "SJPTS_AutoCorpusOverride"
# ------------------------------------------------------------------------------------------------


def answer(japanese: Column, method: Column | str) -> Column:
    """struct(japanese, method), or null where there is no text."""
    m = F.lit(method) if isinstance(method, str) else method
    return F.when(F.coalesce(japanese, F.lit("")) != "", F.struct(japanese.alias("japanese"), m.alias("method")))


def resolve(records: DataFrame, stages: list[Column]) -> DataFrame:
    """Add ``japanese``, ``method`` and ``check`` from the first stage that is not null."""
    got = F.coalesce(*stages)
    out = records.withColumn("_a", got)
    japanese = F.coalesce(F.col("_a.japanese"), F.lit(""))
    return out.withColumn("japanese", japanese).withColumn("method", F.coalesce(F.col("_a.method"), F.lit(""))).withColumn("check", F.when(japanese != "", X.quality_class(japanese)).otherwise("")).drop("_a")


#: The stages in the order in which they are asked.
STAGES = ["preserved", "covered", "cross_mod", "exact", "meaning", "transliteration", "name_fallback", "local_llm", "cloud_llm"]


def run(records: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], on: set[str] | None = None) -> DataFrame:
    """``records`` with ``japanese``, ``method``, ``detail``, ``check`` and ``stage``, each row from the first stage that answers it.

    A stage is a function that gets the rows that all earlier ones left, with their columns, and returns them with ``answer``, a
    struct (japanese, method, detail) or null. What it leaves is written (a durable cut), so that a costly stage runs once and on little. ``on``: the
    stages that are asked, all of ``stages`` by default. Rows that no stage answers have the stage ``unresolved`` and empty texts.
    """
    columns, done, rest = records.columns, [], records
    for name in STAGES:
        if name not in stages or (on is not None and name not in on):
            continue
        told = checkpoint(stages[name](rest).select(*columns, "answer"))
        got = F.coalesce(F.col("answer.japanese"), F.lit("")) != ""
        done.append(told.where(got).select(*columns, "answer.*", F.lit(name).alias("stage")))
        rest = told.where(~got).select(*columns)
        if rest.isEmpty():
            break
    blank = F.lit("")
    out = rest.select(*columns, blank.alias("japanese"), blank.alias("method"), blank.alias("detail"), F.lit("unresolved").alias("stage"))
    for d in done:
        out = out.unionByName(d)
    return out.withColumn("check", F.when(F.col("japanese") != "", X.quality_class(F.col("japanese"))).otherwise(""))


def told(japanese: Column, method: Column | str, detail: Column | None = None) -> Column:
    """A stage's answer, or null where there is no text."""
    m = F.lit(method) if isinstance(method, str) else method
    d = F.lit("") if detail is None else X.blank(detail)
    return F.when(X.blank(japanese) != "", F.struct(japanese.alias("japanese"), m.alias("method"), d.alias("detail")))


def column_stage(japanese: Column, method: Column | str) -> Callable[[DataFrame], DataFrame]:
    """A stage that reads its answer from the row."""
    return lambda rows: rows.withColumn("answer", told(japanese, method))


def meaning_stage(text: str, record_type: str, heads: DataFrame, modifiers: DataFrame, spelling: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def stage(rows: DataFrame) -> DataFrame:
        out = mining.compose(rows, text, heads, modifiers, spelling)
        return out.withColumn("answer", F.when(mining.in_scope(F.col(record_type)), told(F.col("meaning.japanese"), F.col("meaning.method")))).drop("meaning")

    return stage


def spelling_stage(text: str, record_type: str, pieces: DataFrame) -> Callable[[DataFrame], DataFrame]:
    def stage(rows: DataFrame) -> DataFrame:
        asked = rows.where(mining.in_scope(F.col(record_type)))
        found = spelling_ops.transliterate(asked, pieces, text).select(F.col(text).alias("_t"), told(F.col("japanese"), spelling_ops.METHOD, F.col("detail")).alias("_a"))
        out = rows.join(found, F.col(text) == F.col("_t"), "left")
        return out.withColumn("answer", F.when(mining.in_scope(F.col(record_type)), F.col("_a"))).drop("_t", "_a")

    return stage


def name_stage(text: str, record_type: str, words: DataFrame, own: DataFrame | None = None, keys: tuple[str, ...] = ()) -> Callable[[DataFrame], DataFrame]:
    def stage(rows: DataFrame) -> DataFrame:
        asked = rows.where(mining.in_scope(F.col(record_type)))
        found = names.translate(asked, words, text, own, keys)
        found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(text).alias("_t"), told(F.col("japanese"), names.METHOD, F.col("detail")).alias("_a"))
        same = F.col(text) == F.col("_t")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = rows.join(found, same, "left")
        return out.withColumn("answer", F.when(mining.in_scope(F.col(record_type)), F.col("_a"))).drop("_t", "_a", *[f"_{k}" for k in keys])

    return stage


def stage_counts(resolved: DataFrame) -> DataFrame:
    """stage, method and how many rows they answered."""
    return resolved.groupBy("stage", "method").agg(F.count(F.lit(1)).alias("rows"))


def carry_forward(records: DataFrame, previous: DataFrame, keys: list[str], same_text: Column | None = None) -> DataFrame:
    """Join earlier results by key; with ``same_text`` only where the condition (over text and old_text) holds."""
    old = previous.select(*keys, F.col("text").alias("old_text"), F.struct("japanese", "method").alias("kept"))
    out = records.join(old, keys, "left")
    ok = F.coalesce(F.col("kept.japanese"), F.lit("")) != ""
    return out.withColumn("kept", F.when(ok & (same_text if same_text is not None else F.lit(True)), F.col("kept"))).drop("old_text")


def word_glossary(texts: DataFrame, id: str, text: str, lexicons: list[tuple[str, DataFrame]]) -> DataFrame:
    """For each distinct word of three letters or more, the first lexicon (word, japanese) that has it."""
    w = F.array_distinct(F.filter(F.transform(F.split(X.blank(F.col(text)), "[^A-Za-z']+"), F.lower), lambda x: F.char_length(x) >= 3))
    df = texts.select(id, F.posexplode(w).alias("pos", "word"))
    for name, lexicon in lexicons:
        df = df.join(lexicon.select("word", F.struct(F.col("japanese"), F.lit(name).alias("from")).alias(f"_{name}")), "word", "left")
    df = df.withColumn("hit", F.coalesce(*[F.col(f"_{n}") for n, _ in lexicons])).where("hit is not null")
    return df.select(id, "pos", "word", F.col("hit.japanese").alias("japanese"), F.col("hit.from").alias("origin"))


def blockers(unresolved: DataFrame, row: str = "row_id", words: str = "missing", text: str = "text") -> DataFrame:
    """Per unresolved word the number of blocked names and the first of them."""
    w = unresolved.select(row, text, F.explode(F.array_distinct(F.transform(F.col(words), F.lower))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("blocked"), F.min_by(text, row).alias("example"))


def method_pivot(results: DataFrame, group: str, method: str = "method") -> DataFrame:
    """Counts by bucket of methods, one column a bucket."""
    return results.groupBy(group).agg(*[F.count_if(F.col(method).rlike("^" + p)).alias(n) for n, p in BUCKETS.items()])


def hint_priority(method: Column) -> Column:
    """1 (most trusted) to 8, or null for methods that give no hints."""
    out = None
    for i, tag in enumerate(TRUST, 1):
        out = F.when(method == tag, i) if out is None else out.when(method == tag, i)
    return out


def output_rows(rows: DataFrame) -> DataFrame:
    """Rows to write: blank Japanese and malformed form ids go; text without Japanese stays with a notice unless it is an override; blank notes become a proposal."""
    out = rows.where(~X.is_blank(F.col("japanese"))).withColumn("form", X.parse_form_id(F.col("form_id"))).where("form is not null")
    notes = F.coalesce(F.nullif(X.trim(F.col("notes")), F.lit("")), F.lit(PROPOSED))
    return out.withColumn("status", notes).withColumn("notice", ~X.contains_japanese(F.col("japanese")) & (notes != OVERRIDE))
