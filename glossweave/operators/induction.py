"""Transliteration dictionary induced from a bilingual corpus.

Entries are (row_id, english, japanese, source, source_kind). A word or phrase is *committed* by the first event that proposes it, in the order
of passes, then of rows, then within a row; later proposals for it are ignored. The passes: entries that are one
katakana block; the possessor of "X of Y"; then growth, in which an entry whose reading has several segments is split around the
longest phrase already known in it (or taken whole where none is) and the blocks left and right of it are resolved.

Growth is a semi-naive fixed point. An iteration looks only at entries in which a phrase of the last one occurs
(phrases meet entries by an equi-join on their first one or two words, and the reading is matched inside the entry's
segments). Within an iteration a row sees what earlier rows commit: the iteration is repeated on the rows that
its own proposals touch until it repeats itself, which is the result of going through the rows in order, since a row depends on
earlier rows alone.

Defined results: null texts are empty and propose nothing; ties are decided by ``row_id``, which must be unique; equal rows
are rows like any other; an empty corpus gives an empty dictionary. Case of English is ignored in keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import checkpoint

_DOT = "・"
_PLAIN = "^[A-Za-z]{2,}$"
_PHRASE = r"^[ -]*[A-Za-z]{2,}([ -]+[A-Za-z]{2,})*[ -]*$"
#: Passes before growth.
SINGLE, POSSESSOR = -2, -1


def pieces(text: Column) -> Column:
    """The words of a phrase, split at spaces and hyphens: array of (glue, word), glue being what stands before the word."""
    inner = lambda w: F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), lambda p, i: F.struct(F.when(i == 0, " ").otherwise("-").alias("glue"), p.alias("word")))
    return F.flatten(F.transform(X.words(text), inner))


def phrase(parts: Column) -> Column:
    """The text of an array of pieces, without what stands before the first."""
    return F.substring(F.array_join(F.transform(parts, lambda p: F.concat(p["glue"], p["word"])), ""), 2, 1 << 30)


def segments(reading: Column) -> Column:
    return F.split(reading, _DOT)


def katakana(segment: Column) -> Column:
    return segment.rlike(f"^{X.KATAKANA}+$")


def block(parts: Column, readings: Column) -> Column:
    """What a block commits, in order: each word with its segment, then each longer span. Nothing unless there is a segment for
    each word, every segment is katakana and every word plain letters."""
    n = F.size(parts)
    sound = (n > 0) & (n == F.size(readings)) & F.forall(readings, katakana) & F.forall(parts, lambda p: p["word"].rlike(_PLAIN))
    term = lambda a, size: F.struct(phrase(F.slice(parts, a + 1, size)).alias("english"), F.array_join(F.slice(readings, a + 1, size), _DOT).alias("kana"))
    upto = lambda a, b: F.filter(F.sequence(F.lit(0), F.greatest(b, F.lit(0))), lambda i: (i >= a) & (i < b))
    single = F.transform(upto(F.lit(0), n), lambda a: term(a, F.lit(1)))
    spans = F.flatten(F.transform(upto(F.lit(0), n), lambda a: F.transform(upto(F.lit(2), n - a + 1), lambda size: term(a, size))))
    return F.when(sound, F.concat(single, spans)).otherwise(F.array().cast("array<struct<english:string,kana:string>>"))


def entries(corpus: DataFrame) -> DataFrame:
    """row_id, english, japanese (trimmed) of name-like entries with both texts, with their pieces and segments."""
    rows = corpus.select(F.col("row_id").cast("long").alias("row_id"), X.trim(F.col("english")).alias("english"), X.trim(F.col("japanese")).alias("japanese"))
    rows = rows.where((F.char_length("english") >= 2) & (F.col("japanese") != "") & X.looks_like_name(F.col("english")))
    return rows.withColumn("parts", pieces(F.col("english"))).withColumn("segs", segments(F.col("japanese")))


def meaning_words(corpus: DataFrame) -> DataFrame:
    """Words (lower case) that head an "X of ..." entry whose reading is not katakana: they are translated by meaning."""
    rows = corpus.select(X.trim(F.col("english")).alias("english"), X.trim(F.col("japanese")).alias("japanese")).where("japanese <> ''")
    w = X.words(F.col("english"))
    shape = (F.size(w) >= 2) & F.get(w, F.lit(0)).rlike("^[A-Z][A-Za-z]+$") & (F.lower(F.get(w, F.lit(1))) == "of")
    return rows.where(shape & ~katakana(F.replace("japanese", F.lit(_DOT), F.lit("")))).select(F.lower(F.get(w, F.lit(0))).alias("word")).distinct()


def _first(proposed: DataFrame) -> DataFrame:
    """One row a word: the first event that proposes it. A grouped minimum, so a word that many rows propose costs a row a task."""
    event = F.struct("pass", "row_id", "k")
    out = proposed.groupBy("word").agg(F.min_by(F.struct("english", "kana", "pass", "row_id", "k"), event).alias("t"))
    return out.select("word", "t.*")


def _proposals(rows: DataFrame, terms: Column, turn: int, barred: DataFrame) -> DataFrame:
    out = rows.select("row_id", F.posexplode(terms).alias("k", "t")).select(F.lower("t.english").alias("word"), "t.english", "t.kana", F.lit(turn).alias("pass"), "row_id", "k")
    return out.where(F.col("english").rlike(_PHRASE) & (F.col("kana") != "")).join(barred, "word", "left_anti")


def seeds(names: DataFrame, barred: DataFrame) -> DataFrame:
    """The first two passes: entries that are one katakana block, and possessors."""
    one = names.where(~F.contains("japanese", F.lit(_DOT)) & katakana(F.col("japanese")))
    single = _proposals(one, F.array(F.struct("english", F.col("japanese").alias("kana"))), SINGLE, barred)
    w, at = X.words(F.col("english")), F.locate("の", F.col("japanese"))
    owned = names.where((F.size(w) >= 3) & (F.lower(F.get(w, F.lit(1))) == "of") & (at > 1))
    owner = pieces(F.array_join(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), " "))
    reading = segments(F.substring("japanese", F.lit(1), at - 1))
    return _first(single.unionByName(_proposals(owned, block(owner, reading), POSSESSOR, barred)))


def _keys(parts: Column) -> Column:
    """Under what a phrase meets entries: its first word, with the second if it has one."""
    return F.lower(phrase(F.slice(parts, 1, 2)))


def places(growing: DataFrame) -> DataFrame:
    """(row_id, start, key): every word of an entry alone and with the next one."""
    at = F.posexplode("parts").alias("start", "p")
    rows = growing.select("row_id", "parts", at)
    pair = F.when(F.col("start") + 1 < F.size("parts"), F.lower(phrase(F.slice("parts", F.col("start") + 1, 2))))
    return rows.select("row_id", "start", F.explode(F.array_compact(F.array(F.lower("p.word"), pair))).alias("key"))


def matches(terms: DataFrame, growing: DataFrame, at: DataFrame) -> DataFrame:
    """(row_id, start, n, pos, segs_n, by): where a known term stands in an entry's words and its reading in the segments (its
    first place there). ``by`` is the row that committed the term."""
    parts = pieces(F.col("english"))
    known = terms.select("word", F.col("row_id").alias("by"), F.size(parts).alias("n"), _keys(parts).alias("key"), segments(F.col("kana")).alias("known"))
    met = known.join(at, "key").join(growing.select("row_id", "parts", "segs"), "row_id")
    met = met.where(F.lower(phrase(F.slice("parts", F.col("start") + 1, F.col("n")))) == F.col("word"))
    size = F.size("known")
    found = F.filter(F.sequence(F.lit(0), F.size("segs")), lambda i: F.slice("segs", i + 1, size) == F.col("known"))
    return met.select("row_id", "start", "n", F.get(found, F.lit(0)).alias("pos"), size.alias("segs_n"), "by").where("pos is not null")


def split_around(rows: DataFrame, met: DataFrame) -> DataFrame:
    """``rows`` with ``terms``: what the blocks left and right of the longest (then first) match propose, or the whole entry where
    there is no match."""
    best = met.groupBy("row_id").agg(F.max_by(F.struct("start", "n", "pos", "segs_n"), F.struct("n", -F.col("start"))).alias("m"))
    df = rows.join(best, "row_id", "left")
    m = F.col("m")
    cut = lambda c, a, n: F.slice(c, a + 1, F.greatest(n, F.lit(0)))
    left = block(cut(F.col("parts"), F.lit(0), m["start"]), cut(F.col("segs"), F.lit(0), m["pos"]))
    after, behind = m["start"] + m["n"], m["pos"] + m["segs_n"]
    right = block(cut(F.col("parts"), after, F.size("parts") - after), cut(F.col("segs"), behind, F.size("segs") - behind))
    return df.withColumn("terms", F.when(m.isNull(), block(F.col("parts"), F.col("segs"))).otherwise(F.concat(left, right)))


def _mark(terms: DataFrame):
    return tuple(terms.agg(F.count(F.lit(1)), F.sum(F.xxhash64("word", "kana", "row_id", "k").cast("decimal(38,0)"))).first())


def grow(known: DataFrame, names: DataFrame, barred: DataFrame, iterations: int) -> DataFrame:
    """The growth passes: ``known`` terms with what is added until an iteration adds nothing, or for ``iterations``."""
    growing = checkpoint(names.where(F.contains("japanese", F.lit(_DOT)) & (F.size("parts") > 0)).withColumn("word", F.lower("english")))
    at = checkpoint(places(growing))
    seen = checkpoint(matches(known, growing, at))
    touched = None  # rows to look at: all in the first iteration
    for turn in range(iterations):
        found, fresh, mark = None, None, None
        while True:
            rows, met = growing, seen
            if touched is not None:
                ids = touched if fresh is None else touched.unionByName(fresh.select("row_id")).distinct()
                rows = growing.join(ids, "row_id", "left_semi")
            open_ = rows.join(known.select("word"), "word", "left_anti")
            if fresh is not None:  # what earlier rows of this iteration commit is known to later ones
                met = seen.unionByName(fresh.where("by < row_id"))
                open_ = open_.join(found.select("word", F.col("row_id").alias("by")), "word", "left").where("by is null or by >= row_id").drop("by")
            proposed = _proposals(split_around(open_, met), F.col("terms"), turn, barred).join(known.select("word"), "word", "left_anti")
            found = checkpoint(_first(proposed))
            last, mark = mark, _mark(found)
            if mark == last:
                break
            if not mark[0]:
                return known
            fresh = checkpoint(matches(found, growing, at))
            whole = found.select("word", F.col("row_id").alias("by")).join(growing.select("word", "row_id"), "word")
            if fresh.select("by", "row_id").unionByName(whole.select("by", "row_id")).where("by < row_id").isEmpty():
                break  # no later row sees any of it
        known = checkpoint(known.unionByName(found))
        touched = fresh.select("row_id").distinct()
        if touched.isEmpty():
            return known
        seen = checkpoint(seen.unionByName(fresh))
    return known


def running_words(corpus: DataFrame) -> DataFrame:
    """Words (between spaces and hyphens) that some text writes with a small first letter: these are vocabulary, not names."""
    w = corpus.select(F.explode(F.split(X.blank(F.col("english")), "[ -]")).alias("w")).where(F.col("w").rlike(r"^\p{Ll}"))
    return w.select(F.lower("w").alias("word")).distinct()


def induce(corpus: DataFrame, excluded: DataFrame | None = None, iterations: int = 100) -> DataFrame:
    """The dictionary: word (lower case), english (as first seen), kana, pass, row_id, k (the event that committed it).

    ``excluded``: word, not to be learned. Words that running text of the corpus uses in lower case are dropped at the end, phrases stay.
    """
    barred = meaning_words(corpus)
    if excluded is not None:
        barred = barred.unionByName(excluded.select(F.lower("word").alias("word"))).distinct()
    barred = checkpoint(barred)
    names = checkpoint(entries(corpus))
    known = grow(checkpoint(seeds(names, barred)), names, barred, iterations)
    phrases = known.where(F.col("word").rlike("[ -]"))
    return phrases.unionByName(known.where(~F.col("word").rlike("[ -]")).join(running_words(corpus), "word", "left_anti"))


def dictionary(corpus: DataFrame, excluded: DataFrame | None = None, aligned: DataFrame | None = None, iterations: int = 100) -> DataFrame:
    """word, kana, origin (official, sentence, derived), sources (sorted) and tier of the induced dictionary.

    A pair that stands verbatim in the corpus is official. ``aligned`` (word, kana, sources, tier) is added where nothing is known and nothing speaks against it.
    The corpus needs source and tier for this.
    """
    words = checkpoint(induce(corpus, excluded, iterations))
    pairs = corpus.select(X.trim(F.col("english")).alias("english"), X.trim(F.col("japanese")).alias("kana"), "source", "tier")
    shown = words.select("english", "kana").join(pairs, ["english", "kana"]).groupBy("english", "kana").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("tier").alias("tier"))
    out = words.join(shown, ["english", "kana"], "left").select("word", "kana", F.when(F.col("sources").isNotNull(), "official").otherwise("derived").alias("origin"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "tier")
    if aligned is None:
        return out
    barred = meaning_words(corpus)
    if excluded is not None:
        barred = barred.unionByName(excluded.select(F.lower("word").alias("word")))
    more = aligned.select(F.lower("word").alias("word"), "kana", F.lit("sentence").alias("origin"), "sources", "tier")
    return out.unionByName(more.join(words.select("word").unionByName(barred), "word", "left_anti"))
