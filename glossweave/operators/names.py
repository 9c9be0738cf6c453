"""Names put together from known words and phrases, all or nothing, with the provenance of every piece.

A name is read in units: the longest known phrases from left to right, single words elsewhere; a negation takes the
unit after it, and the colours that end a name are one unit. Each unit is looked up, none may fail, and units are joined by
the particle or space that stands between them.

Everything is set-wise. Distinct names are unfolded into words; phrases meet them by an equi-join on their first two
words; distinct words meet the lexicon under all the forms that they may stand in (as they are, hyphenated parts, without a
plural s) and keep the best form that is known in full. Arrays of a name's own words are folded in the row.

Defined results: a null or empty name and one that is not name-like gives no Japanese and misses nothing; repeated rows get equal
results; an empty table gives an empty table; the case of English is ignored in the lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .overlay import first_by

# --- Fixed values ---------------------------------------------------------------------------
COLOURS = [
    "red", "black", "white", "blue", "green", "yellow", "purple", "orange", "pink", "brown", "grey", "gray", "silver", "gold", "golden", "bronze", "ivory", "ebony",
    "amber", "crimson", "emerald", "maroon", "navy", "obsidian", "redwort", "ruby", "sapphire", "scarlet", "umber",
]
NEGATIONS = ["no", "not"]
OF, AND = "の", "と"
METHOD = "SJPTS_TranslationNameFallback"
AS_IT_IS, OWN = "そのまま", "MOD用語集"
LABELS = {"exact": "①完全一致", "meaning": "②意味", "kana": "③音訳", "glossary": "全体用語集(Data/name_glossary.tsv)"}
KEEP = "="  # a plugin's glossary: the word stays as it is
# ----------------------------------------------------------------------------------------------
#: Sources of a shared lexicon, best first.
SOURCES = list(LABELS)


def lexicon(**sources: DataFrame) -> DataFrame:
    """One row a word (lower case): word, japanese, source, exact. ``sources`` are tables (word, japanese, source) named as in ``SOURCES``."""
    rows = None
    for rank, name in enumerate(SOURCES):
        if name in sources:
            label = F.lit(LABELS[name]) if name == "glossary" else F.concat(F.lit(LABELS[name]), F.when(X.blank(F.col("source")) != "", F.concat(F.lit("["), "source", F.lit("]"))).otherwise(""))
            t = sources[name].select(F.lower(X.trim(F.col("word"))).alias("word"), "japanese", label.alias("source"), F.lit(rank).alias("rank")).where("word <> '' and japanese <> ''")
            rows = t if rows is None else rows.unionByName(t)
    best = first_by(rows, ["word"], [F.asc("rank"), F.asc("japanese"), F.asc("source")])
    return best.select("word", "japanese", "source", (F.col("rank") == 0).alias("exact"))


def bare(word: Column) -> Column:
    """A word without a possessive ending and the punctuation behind it."""
    return F.regexp_replace(F.regexp_replace(word, "(?i)'s$", ""), "[,:;]+$", "")


def _reordered(text: Column) -> Column:
    """What follows the first " of " in front, without its article."""
    at = F.locate(" of ", text)
    before, after = X.trim(F.substring(text, F.lit(1), at - 1)), X.trim(F.substring(text, at + 4, F.lit(1 << 30)))
    after = X.trim(F.regexp_replace(after, "(?i)^(the|an|a) ", ""))
    return F.when((at > 1) & (before != "") & (after != ""), F.concat(after, F.lit(" "), before)).otherwise(text)


def read(names: DataFrame, name: str = "name", kept_words: Column | None = None) -> DataFrame:
    """``names`` with ``tag`` (a bracketed prefix), ``words`` and ``links``, what stands before each word but the first.
    ``kept_words``: array of words (lower case) that stay as they are, like numbers."""
    passes = lambda w: X.is_pass_through(w) if kept_words is None else X.is_pass_through(w) | F.array_contains(kept_words, F.lower(F.regexp_replace(w, "[,:;]+$", "")))
    text = X.trim(F.col(name))
    tag = F.regexp_extract(text, r"^\[[^\]]*\]", 0)
    body = F.when(tag != "", X.trim(F.substring(text, F.char_length(tag) + 1, F.lit(1 << 30)))).otherwise(text)
    df = names.withColumn("tag", tag).withColumn("body", body)
    df = df.withColumn("body", F.when(X.looks_like_name(F.col("body")), F.col("body")).otherwise(""))
    df = df.withColumn("all", X.words(_reordered(F.col("body"))))
    kept = F.filter(F.transform("all", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: ~F.lower(x["word"]).isin("and", "the"))
    df = df.withColumn("kept", kept).withColumn("words", F.col("kept.word"))

    def link(x: Column, i: Column) -> Column:
        last = F.get(F.col("kept"), i - 1)
        skipped = F.slice("all", last["at"] + 2, F.greatest(x["at"] - last["at"] - 1, F.lit(0)))
        apart = x["word"].startswith("(") | last["word"].endswith(":") | passes(x["word"]) | passes(last["word"])
        return F.when(i == 0, "").when(apart, " ").when(F.exists(skipped, lambda w: F.lower(w) == "and"), AND).otherwise(OF)

    return df.withColumn("links", F.transform("kept", link)).drop("body", "all", "kept")


def phrase_matches(read_names: DataFrame, words: DataFrame, id: str = "name") -> DataFrame:
    """(name, found): for each place of a name's words where a known phrase of two or more words starts, the longest one:
    array of (at, n, japanese, source). Only exact entries are phrases."""
    parts = X.words(F.col("word"))
    known = words.where(F.col("exact") & (F.size(parts) >= 2)).select(F.array_join(parts, " ").alias("word"), "japanese", "source", F.size(parts).alias("n"), F.array_join(F.slice(parts, 1, 2), " ").alias("pair"))
    low = read_names.select(id, F.transform("words", F.lower).alias("low")).where("size(low) >= 2")
    at = low.select(id, "low", F.explode(F.sequence(F.lit(0), F.size("low") - 2)).alias("at")).withColumn("pair", F.array_join(F.slice("low", F.col("at") + 1, 2), " "))
    met = at.join(known, "pair").where(F.array_join(F.slice("low", F.col("at") + 1, F.col("n")), " ") == F.col("word"))
    longest = met.groupBy(id, "at").agg(F.max_by(F.struct("at", "n", "japanese", "source"), F.struct("n", "word")).alias("m"))
    return longest.groupBy(id).agg(F.sort_array(F.collect_list("m")).alias("found"))


def units(words: Column, found: Column) -> Column:
    """The units of a name: array of (at, n, word, negated, japanese, source). ``japanese`` is there if a phrase gives it."""
    n = F.size(words)
    match = lambda i: F.get(F.filter(found, lambda m: m["at"] == i), F.lit(0))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(i: Column) -> Column:
        here, after = match(i), match(i + 1)
        negated = here.isNull() & (i + 1 < n) & F.lower(F.get(words, i)).isin(NEGATIONS)
        own = F.coalesce(here["n"], F.lit(1))
        taken = F.when(negated, 1 + F.coalesce(after["n"], F.lit(1))).otherwise(own)
        word = F.get(words, F.when(negated, i + 1).otherwise(i))
        pick = lambda c: F.when(negated, after[c]).otherwise(here[c])
        return F.struct(i.alias("at"), taken.alias("n"), word.alias("word"), negated.alias("negated"), pick("japanese").alias("japanese"), pick("source").alias("source"))

    every = F.transform(places, unit)
    first = F.struct(F.lit(0).alias("next"), F.filter(every, lambda u: F.lit(False)).alias("units"))
    step = lambda s, u: F.when(u["at"] == s["next"], F.struct((u["at"] + u["n"]).alias("next"), F.concat(s["units"], F.array(u)).alias("units"))).otherwise(s)
    return F.aggregate(every, first, step, lambda s: s["units"])


def _forms(word: Column) -> Column:
    """Under what a word is looked up, best first: array of (rank, part, parts, form, text, own), ``text`` being the form as written. ``own`` forms are for the glossary
    of the name's own plugin, which comes before all others."""
    inside = F.when(word.rlike(r"^\(.+\)$"), F.substring(word, F.lit(2), F.char_length(word) - 2))
    plural = lambda c: F.when((F.char_length(c) > 3) & c.rlike("(?i)[^s]s$"), F.substring(c, F.lit(1), F.char_length(c) - 1))
    form = lambda rank, part, parts, f, own: F.struct(F.lit(rank).alias("rank"), part.alias("part"), parts.alias("parts"), F.lower(f).alias("form"), f.alias("text"), F.lit(own).alias("own"))
    one = lambda rank, f, own: form(rank, F.lit(0), F.lit(1), f, own)
    inner, outer = bare(inside), bare(word)
    core = F.coalesce(inner, outer)
    halves = F.filter(F.split(core, "-"), lambda p: p != "")
    hyphen = F.when(core.contains("-") & (F.size(halves) > 1), F.transform(halves, lambda p, i: form(5, i, F.size(halves), p, False)))
    single = F.array(one(0, inner, True), one(1, plural(inner), True), one(2, outer, True), one(3, plural(outer), True), one(4, core, False), one(6, plural(core), False))
    return F.filter(F.concat(single, F.coalesce(hyphen, F.slice(single, 1, 0))), lambda x: x["form"].isNotNull() & (x["form"] != ""))


def resolve_words(asked: DataFrame, words: DataFrame, own: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` (keys..., word), distinct, with ``japanese`` and ``source`` where the word is known or passes as it is.
    ``own``: (keys..., word, japanese), the glossaries of the names' own plugins."""
    forms = asked.select(*keys, "word", F.explode(_forms(F.col("word"))).alias("f")).select(*keys, "word", "f.*")
    shared = forms.where(~F.col("own")).join(words.select(F.col("word").alias("form"), "japanese", "source"), "form")
    if own is not None:
        mine = own.select(*keys, F.lower(X.trim(F.col("word"))).alias("form"), "japanese").where("form <> ''")
        mine = first_by(mine, [*keys, "form"], [F.asc("japanese")]).withColumn("source", F.lit(OWN))
        mine = forms.where("own").join(mine, [*keys, "form"]).withColumn("japanese", F.when(F.col("japanese") == KEEP, F.col("text")).otherwise(F.col("japanese")))
        shared = shared.unionByName(mine)
    part = F.sort_array(F.collect_list(F.struct("part", "japanese", "source")))
    whole = shared.groupBy(*keys, "word", "rank", "parts").agg(part.alias("found")).where("size(found) = parts")
    best = whole.groupBy(*keys, "word").agg(F.min_by("found", "rank").alias("found"), F.min("rank").alias("rank"))
    text = F.array_join("found.japanese", "")
    # parentheses stay around what stands inside them, unless the word was found with them
    wrapped = F.when(F.col("word").rlike(r"^\(.+\)$") & ~F.col("rank").isin(2, 3), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    best = best.select(*keys, "word", wrapped.alias("japanese"), F.array_join(F.array_distinct("found.source"), "+").alias("source"))
    same = X.is_pass_through(F.col("word"))
    out = asked.join(best, [*keys, "word"], "left")
    return out.select(*keys, "word", F.coalesce("japanese", F.when(same, F.col("word"))).alias("japanese"), F.coalesce("source", F.when(same, AS_IT_IS)).alias("source"))


def _assembled(df: DataFrame) -> DataFrame:
    """``japanese``, ``detail`` and ``missing`` from tag, words, links and units (with what was found for each)."""
    u = F.col("units")
    colour = lambda x: ~x["negated"] & x["japanese"].isNull() & F.lower(bare(x["word"])).isin(COLOURS)
    other = F.array_max(F.filter(F.transform(u, lambda x, i: F.when(~colour(x) | (i == 0), i)), lambda i: i.isNotNull()))
    df = df.withColumn("cut", F.coalesce(other + 1, F.lit(0)))
    text = lambda x: F.coalesce(x["japanese"], x["found"])
    origin = lambda x: F.coalesce(x["source"], x["found_source"])
    shown = lambda x: F.array_join(F.slice("words", x["at"] + 1, x["n"]), " ")
    piece = lambda at, s, japanese, source, apart: F.struct(at.alias("at"), s.alias("shown"), japanese.alias("japanese"), source.alias("source"), apart.alias("apart"))
    negated = lambda x: F.concat(F.lit("（"), text(x), F.lit("なし）"))
    plain = F.transform(F.slice(u, 1, F.col("cut")), lambda x: piece(x["at"], shown(x), F.when(x["negated"], negated(x)).otherwise(text(x)), origin(x), x["negated"]))
    tail = F.slice(u, F.col("cut") + 1, F.size(u))
    joined = piece(
        F.get(tail, F.lit(0))["at"], F.array_join(F.transform(tail, lambda x: x["word"]), " "), F.concat(F.lit("（"), F.array_join(F.transform(tail, text), "・"), F.lit("）")),
        F.array_join(F.array_distinct(F.transform(tail, origin)), ", "), F.lit(True),
    )
    df = df.withColumn("pieces", F.when(F.size(tail) > 0, F.concat(plain, F.array(joined))).otherwise(plain))
    missing = F.transform(F.filter(u, lambda x: text(x).isNull()), lambda x: F.regexp_replace(x["word"], "[,:;]+$", ""))
    p = F.col("pieces")
    join = lambda x, i: F.when(i == 0, "").when(x["apart"] | F.get(p, i - 1)["apart"], " ").otherwise(F.get(F.col("links"), x["at"]))
    body = F.array_join(F.transform(p, lambda x, i: F.concat(join(x, i), x["japanese"])), "")
    lead = F.when(F.col("tag") != "", F.concat("tag", F.lit(" "))).otherwise("")
    detail = F.array_join(F.transform(p, lambda x: F.concat(F.lit('"'), x["shown"], F.lit('"→"'), x["japanese"], F.lit('"('), x["source"], F.lit(")"))), " + ")
    whole = (F.size(missing) == 0) & (F.size(u) > 0)
    return df.withColumns({"japanese": F.when(whole, F.concat(lead, body)), "detail": F.when(whole, detail), "missing": missing})


def translate(names: DataFrame, words: DataFrame, name: str = "name", own: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (keys..., name) with ``japanese``, ``detail`` (pieces with their sources) and ``missing`` (unresolved words in order).

    ``words``: a ``lexicon``; ``own``: (keys..., word, japanese), glossaries that belong to the keys (say the plugin).
    """
    ids = [*keys, name]
    rows = names.select(*ids).distinct().where(F.col(name).isNotNull())
    if own is not None:
        stay = own.where(F.col("japanese") == KEEP).groupBy(*keys).agg(F.collect_set(F.lower(X.trim(F.col("word")))).alias("stay"))
        rows = read(rows.join(stay, [*keys], "left").withColumn("stay", F.coalesce("stay", F.array().cast("array<string>"))), name, F.col("stay")).drop("stay")
    else:
        rows = read(rows, name)
    found = phrase_matches(rows, words, name) if not keys else phrase_matches(rows.dropDuplicates([name]), words, name)
    none = F.array().cast("array<struct<at:int,n:int,japanese:string,source:string>>")
    rows = rows.join(found, name, "left").withColumn("units", units(F.col("words"), F.coalesce("found", none)))
    each = rows.select(*ids, F.posexplode("units").alias("k", "u"))
    asked = each.where("u.japanese is null").select(*keys, F.col("u.word").alias("word")).distinct()
    known = resolve_words(asked, words, own, keys).select(*keys, "word", F.col("japanese").alias("found"), F.col("source").alias("found_source"))
    told = each.withColumn("word", F.col("u.word")).join(known, [*keys, "word"], "left")
    told = told.select(*ids, F.struct("k", "u.*", F.when(F.col("u.japanese").isNull(), F.col("found")).alias("found"), "found_source").alias("u"))
    told = told.groupBy(*ids).agg(F.sort_array(F.collect_list("u")).alias("units"))
    out = rows.drop("units", "found").join(told, ids, "left")
    empty = F.array().cast(told.schema["units"].dataType)
    return _assembled(out.withColumn("units", F.coalesce("units", empty))).select(*ids, "japanese", "detail", "missing")
