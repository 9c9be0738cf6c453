"""Dictionaries mined from a bilingual corpus: alignment, head and modifier lexicons, transliterations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs
from .batch import Profile
from .overlay import first_by

# --- Fixed values ---------------------------------------------------------------------------
MIN_TOGETHER, MIN_DICE = 2, 0.45
WITNESS_CHARS, WITNESS_RUNS = 150, 2
HEAD_SUPPORT, MODIFIER_HEADS = 3, 2
# ----------------------------------------------------------------------------------------------
RUN = X.KATAKANA.replace("[", "[ー") + "+"


def pair_words(corpus: DataFrame, longest: int = 20_000, max_words: int = 3_000, max_runs: int = 1_000) -> DataFrame:
    """row_id, ws (distinct lower-case words), rs (distinct katakana runs of two or more) of usable rows."""
    ws = F.array_distinct(F.transform(F.regexp_extract_all(X.blank(F.col("english")), F.lit("[A-Za-z][A-Za-z']*"), 0), F.lower))
    rs = F.array_distinct(F.filter(F.regexp_extract_all(X.blank(F.col("japanese")), F.lit(RUN), 0), lambda r: F.char_length(r) >= 2))
    df = corpus.where(F.char_length("english").between(1, longest)).select("row_id", ws.alias("ws"), rs.alias("rs"))
    return df.where(F.size("ws").between(1, max_words) & F.size("rs").between(1, max_runs))


def co_occurrence(pairs: DataFrame, least: int = 1, min_dice: float = 0.0) -> DataFrame:
    """word, run, together, word_n, run_n, dice of pairs that occur ``least`` times together with a Dice of ``min_dice``.

    Words and runs of fewer rows than ``least`` leave before the product of a row is formed, and of the others only those are paired
    whose row counts allow the Dice: it is at most twice the lesser count over both. Both bounds are exact.
    """
    words = pairs.select("row_id", F.explode("ws").alias("word"))
    runs = pairs.select("row_id", F.explode("rs").alias("run"))
    word_n = words.groupBy("word").agg(F.count(F.lit(1)).alias("word_n")).where(F.col("word_n") >= least)
    run_n = runs.groupBy("run").agg(F.count(F.lit(1)).alias("run_n")).where(F.col("run_n") >= least)
    w = words.join(word_n, "word").groupBy("row_id").agg(F.collect_list(F.struct("word", "word_n")).alias("ws"))
    r = runs.join(run_n, "run").groupBy("row_id").agg(F.collect_list(F.struct("run", "run_n")).alias("rs"))
    # the runs that a word's count allows are taken from the row's list before any pair is made
    both = w.join(r, "row_id").select(F.explode("ws").alias("w"), "rs")
    allowed = F.filter("rs", lambda x: F.lit(2.0) * F.least(F.col("w.word_n"), x["run_n"]) >= F.lit(min_dice - 1e-9) * (F.col("w.word_n") + x["run_n"]))
    both = both.select("w", F.explode(allowed).alias("r"))
    out = both.groupBy("w.word", "r.run").agg(F.count(F.lit(1)).alias("together"), F.first("w.word_n").alias("word_n"), F.first("r.run_n").alias("run_n"))
    out = out.withColumn("dice", F.lit(2.0) * F.col("together") / (F.col("word_n") + F.col("run_n")))
    return out.where((F.col("together") >= least) & (F.col("dice") >= min_dice - 1e-9))


def best_pairs(table: DataFrame, least: int = MIN_TOGETHER, min_dice: float = MIN_DICE, credible: Column | None = None) -> DataFrame:
    """The word of highest Dice for each run, if it is ``credible``, then the first run of each word; ties by word and run."""
    per_run = first_by(table.where(F.col("together") >= least), ["run"], [F.desc(F.round("dice", 12)), F.asc("word")]).where(F.col("dice") >= min_dice)
    per_run = per_run if credible is None else per_run.where(credible)
    return first_by(per_run, ["word"], [F.desc(F.round("dice", 12)), F.asc("run")])


def vouched(mined: DataFrame, corpus: DataFrame) -> DataFrame:
    """Mined (word, run) pairs that a short entry shows: it has one or two runs, holds the run, and has the word between
    non-letters. An equi-join on the entry's words, never a cross join."""
    n = F.regexp_count("japanese", F.lit(RUN))
    short = corpus.where(F.char_length("english").between(1, WITNESS_CHARS) & n.between(1, WITNESS_RUNS))
    w = short.select("japanese", F.explode(F.array_distinct(F.transform(F.concat(F.regexp_extract_all("english", F.lit("[A-Za-z]+"), 0), F.regexp_extract_all("english", F.lit("[A-Za-z][A-Za-z']*"), 0)), F.lower))).alias("word"))
    return mined.join(w, "word").where(F.contains("japanese", F.col("run"))).groupBy("word", "run").agg(F.count(F.lit(1)).alias("witnesses"))


def align(corpus: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Sentence alignment: best pairs that are phonetically plausible and vouched for."""
    p = profile or Profile()
    pairs = co_occurrence(pair_words(corpus, p.longest, p.max_words, p.max_runs), p.together, p.dice)
    return vouched(best_pairs(pairs, p.together, p.dice, udfs.plausible(F.col("word"), F.col("run"))), corpus)


def heads(corpus: DataFrame, least: int = HEAD_SUPPORT) -> DataFrame:
    """The reading of each head word: with ``least`` distinct Japanese texts, votes by reading (the trailing katakana), the
    lowest tier that has a reading, most votes, shortest reading, then the reading itself."""
    df = corpus.withColumn("s", X.split_head(F.col("english"))).where("s is not null")
    df = df.select(F.lower("s.head").alias("head"), X.trailing_katakana(F.col("japanese")).alias("reading"), "japanese", "tier")
    support = df.groupBy("head").agg(F.countDistinct("japanese").alias("kinds")).where(F.col("kinds") >= least)
    votes = df.where("reading <> ''").groupBy("head", "reading").agg(F.countDistinct("japanese").alias("votes"), F.min("tier").alias("tier"))
    return first_by(votes.join(support, "head"), ["head"], [F.asc("tier"), F.desc("votes"), F.asc(F.char_length("reading")), F.asc("reading")])


def modifiers(corpus: DataFrame, head_lexicon: DataFrame, least: int = MODIFIER_HEADS) -> DataFrame:
    """The rendering of each modifier: what is left of the Japanese before the head's reading, seen with ``least`` heads,
    kept only if it is the single one at its best tier."""
    df = corpus.withColumn("s", X.split_head(F.col("english"))).where("s is not null")
    df = df.select(F.lower("s.head").alias("head"), F.lower("s.modifier").alias("modifier"), "japanese", "tier").join(head_lexicon.select("head", "reading"), "head")
    df = df.where(F.endswith("japanese", F.col("reading")))
    rest = F.expr("left(japanese, length(japanese) - length(reading))")
    df = df.withColumn("rendering", F.regexp_replace(rest, "[の・]$", "")).where("rendering <> ''")
    seen = df.groupBy("modifier", "rendering").agg(F.countDistinct("head").alias("heads"), F.min("tier").alias("tier")).where(F.col("heads") >= least)
    best = seen.groupBy("modifier").agg(F.min("tier").alias("tier"))
    top = seen.join(best, ["modifier", "tier"])
    return top.groupBy("modifier").agg(F.count(F.lit(1)).alias("n"), F.min("rendering").alias("rendering"), F.min("tier").alias("tier")).where("n = 1").drop("n")


def compose(records: DataFrame, text: str, head_lexicon: DataFrame, modifier_lexicon: DataFrame, spelling: DataFrame) -> DataFrame:
    """Modifier + の + head. The lexicon's modifier is taken if its tier is no worse than the transliteration's. Adds ``meaning``."""
    df = records.withColumn("_s", X.split_head(F.col(text)))
    df = df.withColumn("_h", F.lower("_s.head")).withColumn("_m", F.lower("_s.modifier"))
    h = head_lexicon.select(F.col("head").alias("_h"), F.col("reading").alias("_hr"))
    m = modifier_lexicon.select(F.col("modifier").alias("_m"), F.col("rendering").alias("_mr"), F.col("tier").alias("_mt"))
    t = spelling.select(F.col("word").alias("_m"), F.col("kana").alias("_tr"), F.col("tier").alias("_tt"))
    df = df.join(h, "_h", "left").join(m, "_m", "left").join(t, "_m", "left")
    lexicon_first = F.col("_mr").isNotNull() & (F.col("_tt").isNull() | (F.col("_mt") <= F.col("_tt")))
    mod = F.when(lexicon_first, F.col("_mr")).otherwise(F.col("_tr"))
    method = F.when(lexicon_first, "SJPTS_AutoCorpusMeaning").otherwise("SJPTS_AutoCorpusMeaningTranslit")
    found = F.when(F.col("_hr").isNotNull() & mod.isNotNull(), F.struct(F.concat(mod, F.lit("の"), F.col("_hr")).alias("japanese"), method.alias("method")))
    return df.withColumn("meaning", found).drop("_s", "_h", "_m", "_hr", "_mr", "_mt", "_tr", "_tt")


def official(dictionary: DataFrame, corpus: DataFrame, english: str = "english", japanese: str = "japanese") -> DataFrame:
    """Pairs that stand verbatim in the corpus, with where they stand."""
    c = corpus.select(F.lower(X.trim(F.col(english))).alias("word"), F.col(japanese).alias("kana"), "source")
    return dictionary.join(c, ["word", "kana"]).groupBy("word", "kana").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def in_scope(record_type: Column) -> Column:
    """Full names other than persons'."""
    return record_type.endswith(" FULL") & (record_type != "NPC_ FULL")
