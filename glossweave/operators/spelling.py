"""Transliteration of unseen names from known pieces.

Words meet pieces by an equi-join on three letters (a piece is at least as long), the rest of a piece is compared in the row, and
the pieces that fit are folded from the end of the word: from every place the longest piece that leaves a solvable rest. A
word that is known on its own is taken whole; a whole word is never a piece of itself otherwise. Names of several words are
regrouped from their words, all or nothing, and joined by ・.

Defined results: null and empty names, and names with a word without letters, have no reading; case and what is no letter are
ignored; ties cannot occur, since pieces are unique; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .overlay import first_by

#: Letters in the shortest piece (fixed value).
LEAST = 3
METHOD = "SJPTS_AutoCorpusTransliterate"  # fixed value


def decompose(words: DataFrame, pieces: DataFrame, word: str = "word") -> DataFrame:
    """Distinct ``word`` (lower case) with ``kana`` and ``parts`` (piece, kana, source) of those that known pieces cover.

    ``pieces``: word, kana, source, and alone, whether the word may stand for itself.
    """
    known = pieces.select(F.lower("word").alias("piece"), "kana", X.blank(F.col("source")).alias("source"), "alone").where("piece <> '' and kana <> ''")
    known = first_by(known, ["piece"], [F.desc("alone"), F.asc("kana"), F.asc("source")])
    asked = words.select(F.lower(word).alias("w")).where("w <> ''").distinct()
    whole = asked.join(known.where("alone"), F.col("w") == F.col("piece")).select("w", "kana", F.array(F.struct("piece", "kana", "source")).alias("parts"))
    rest = asked.join(whole.select("w"), "w", "left_anti").where(F.char_length("w") >= LEAST)
    at = rest.select("w", F.explode(F.sequence(F.lit(0), F.char_length("w") - LEAST)).alias("i")).withColumn("key", F.substr("w", F.col("i") + 1, F.lit(LEAST)))
    long = known.where(F.char_length("piece") >= LEAST).select("piece", "kana", "source", F.substring("piece", 1, LEAST).alias("key"))
    fits = at.join(long, "key").where((F.substr("w", F.col("i") + 1, F.char_length("piece")) == F.col("piece")) & (F.col("piece") != F.col("w")))
    fit = F.struct(F.col("i"), (F.col("i") + F.char_length("piece")).alias("j"), "piece", "kana", "source")
    found = fits.groupBy("w").agg(F.sort_array(F.collect_list(fit), asc=False).alias("fits"))
    none = F.array().cast("array<struct<piece:string,kana:string,source:string>>")
    start = F.array(F.struct(F.char_length("w").alias("at"), F.lit("").alias("kana"), none.alias("parts")))

    def step(solved, m):
        behind = F.get(F.filter(solved, lambda s: s["at"] == m["j"]), F.lit(0))
        new = F.struct(m["i"].alias("at"), F.concat(m["kana"], behind["kana"]).alias("kana"), F.concat(F.array(F.struct(m["piece"].alias("piece"), m["kana"].alias("kana"), m["source"].alias("source"))), behind["parts"]).alias("parts"))
        return F.when(behind.isNotNull() & ~F.exists(solved, lambda s: s["at"] == m["i"]), F.concat(solved, F.array(new))).otherwise(solved)

    solved = F.aggregate("fits", start, step)
    covered = found.select("w", F.get(F.filter(solved, lambda s: s["at"] == 0), F.lit(0)).alias("s")).where("s is not null")
    return whole.unionByName(covered.select("w", "s.kana", "s.parts")).withColumnRenamed("w", word)


def transliterate(names: DataFrame, pieces: DataFrame, name: str = "name") -> DataFrame:
    """Distinct ``name`` with ``japanese`` and ``detail`` of those whose every word has a reading: single words, and phrases that look like
    proper nouns."""
    rows = names.select(name).distinct().withColumn("t", X.trim(F.col(name))).where("t <> ''")
    single = ~F.col("t").rlike("[ \t]")
    rows = rows.where(single | X.looks_like_proper_noun(F.col("t")))
    bare = lambda w: F.lower(F.regexp_replace(w, r"\P{L}", ""))
    rows = rows.withColumn("ws", F.transform(F.when(single, F.array("t")).otherwise(X.words(F.col("t"))), bare))
    rows = rows.where((F.size("ws") > 0) & F.forall("ws", lambda w: w != ""))
    each = rows.select(name, F.size("ws").alias("n"), F.posexplode("ws").alias("k", "word"))
    known = decompose(each.select("word"), pieces)
    told = each.join(known, "word").groupBy(name, "n").agg(F.sort_array(F.collect_list(F.struct("k", "word", "kana", "parts"))).alias("ws")).where("size(ws) = n")
    shown = lambda x: F.concat(F.lit('"'), x["word"], F.lit('"→"'), x["kana"], F.lit('"'), F.when(F.size(x["parts"]) > 1, F.concat(F.lit("("), F.array_join(F.transform(x["parts"], lambda p: p["piece"]), "+"), F.lit(")"))).otherwise(""))
    return told.select(name, F.array_join("ws.kana", "・").alias("japanese"), F.array_join(F.transform("ws", shown), " ・ ").alias("detail"))
