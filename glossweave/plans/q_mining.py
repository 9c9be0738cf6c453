"""Queries of retrieval, key phrases, mined dictionaries, the cascade and batches. Japanese text is a fixed
letter map of the English, so that alignment has something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cascade, corpus, induction, mining, names, phrases, retrieval, rounds, spelling
from .q_text import TOKENS
from .registry import query, table

SENT = "SELECT item_id AS id, unnest(string_split(text, '.')) AS text FROM benchmark"
N_TOK = f"(SELECT id, text, unnest({TOKENS}) AS token FROM docs)"
DOCS = "docs AS (SELECT item_id AS id, text FROM benchmark)"


def bench(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


@query("a07_document_frequency", f"WITH {DOCS} SELECT token, count(*) AS df FROM {N_TOK} GROUP BY 1")
def a07(spark, d):
    t = bench(spark, d).select("id", F.explode(X.retrieval_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


IDF = f"{DOCS}, t AS (SELECT id, token FROM {N_TOK}), idf AS (SELECT token, ln((SELECT count(*) FROM docs)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM t GROUP BY 1)"


@query("x13_idf", f"WITH {IDF} SELECT token, round(idf, 6) AS idf FROM idf")
def x13(spark, d):
    return retrieval.index(bench(spark, d), "id", "text")[2].select("token", F.round("idf", 6).alias("idf"))


SIM = f"""{IDF}, p AS (SELECT id, token, idf FROM t JOIN idf USING (token)), nrm AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM p GROUP BY 1),
 dot AS (SELECT q.id AS query, p.id, sum(p.idf * q.idf) AS dot FROM p q JOIN p ON p.token = q.token WHERE p.id IN (SELECT id FROM docs WHERE length(text) <= 500) GROUP BY ALL),
 sim AS (SELECT query, d.id, dot / (n.norm * qn.norm) AS score FROM dot d JOIN nrm n ON n.id = d.id JOIN nrm qn ON qn.id = query)"""
KIND = "CASE {c} % 3 WHEN 0 THEN 'WEAP FULL' WHEN 1 THEN 'WEAP DESC' ELSE 'ARMO FULL' END"
QK, IK = KIND.format(c="query"), KIND.format(c="id")
BOOST = f"boost AS (SELECT query, id, score + CASE WHEN query % 4 = id % 4 THEN 0.06 ELSE 0.0 END + CASE WHEN {QK} = {IK} THEN 0.04 WHEN split_part({QK}, ' ', 1) = split_part({IK}, ' ', 1) THEN 0.02 ELSE 0.0 END AS score FROM sim)"
NEAR = "SELECT query, id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM {}) WHERE score >= 0.4 * best"


@query("x14_cosine", f"WITH {SIM} " + NEAR.format("sim"))
def x14(spark, d):
    b = bench(spark, d)
    return retrieval.similar(b, b, "id", "text", "id", "text").select("query", "id", F.round("score", 6).alias("score"))


def boosted(spark, d):
    b = bench(spark, d).withColumn("plugin", F.col("id") % 4).withColumn("kind", F.expr(KIND.format(c="id")))
    extra = retrieval.bonus(F.col("q_plugin") == F.col("e_plugin"), F.col("q_kind"), F.col("e_kind"))
    return retrieval.similar(b, b, "id", "text", "id", "text", extra=extra, most=retrieval.BONUS_PLUGIN + retrieval.BONUS_TYPE, more=("plugin", "kind"))


@query("x15_affinity_bonus", f"WITH {SIM}, {BOOST} " + NEAR.format("boost"))
def x15(spark, d):
    return boosted(spark, d).select("query", "id", F.round("score", 6).alias("score"))


CUT = "SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS rank, score >= 0.4 * max(score) OVER (PARTITION BY query) AS ok FROM {}) WHERE ok AND rank <= {}"


@query("m09_precedent_retrieval", f"WITH {SIM}, {BOOST} " + CUT.format("boost", 10))
def m09(spark, d):
    return retrieval.cut(boosted(spark, d), 10).select("query", "id", "rank")


HINTS = f"""WITH docs AS (SELECT item_id AS id, item_id // 10 % 4 AS grp, item_id % 2 AS done, text FROM benchmark), t AS (SELECT id, grp, done, unnest({TOKENS}) AS token FROM docs),
 n AS (SELECT grp, count(*) AS n FROM docs WHERE done = 1 GROUP BY 1), idf AS (SELECT grp, token, ln(n::DOUBLE / (df + 1)) + 1 AS idf FROM (SELECT grp, token, count(*) AS df FROM t WHERE done = 1 GROUP BY ALL) JOIN n USING (grp)),
 v AS (SELECT t.*, coalesce(idf, ln(n::DOUBLE) + 1) AS w FROM t JOIN n USING (grp) LEFT JOIN idf USING (grp, token)), nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
 dot AS (SELECT grp, q.id AS query, p.id, sum(p.w * q.w) AS dot FROM v q JOIN v p USING (grp, token) WHERE q.done = 0 AND p.done = 1 GROUP BY ALL),
 sim AS (SELECT grp, d.id, dot / (n.norm * qn.norm) AS score FROM dot d JOIN nrm n ON n.id = d.id JOIN nrm qn ON qn.id = query),
 pool AS (SELECT grp, id, max(score) AS score FROM sim GROUP BY ALL),
 b AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY round(score, 9) DESC, id % 3, id) AS rank, score >= 0.4 * max(score) OVER (PARTITION BY grp) AS ok FROM pool)
 SELECT grp, id, rank FROM b WHERE ok AND rank <= 10"""


@query("m10_same_mod_hints", HINTS)
def m10(spark, d):
    b = bench(spark, d).withColumn("grp", F.expr("id div 10 % 4"))
    return retrieval.same_mod_hints(b.where("id % 2 = 0"), b.where("id % 2 = 1").withColumn("trust", F.col("id") % 3), "id", "text", "grp", 10, tie=("trust", "id")).select("grp", "id", "rank")


@query("o04_latest_import_first", "SELECT event_type, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY 1")
def o04(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


GR = """w AS (SELECT item_id AS id, item_id % 4 AS grp, text, list_filter(regexp_extract_all(text, '[\\p{L}\\p{Nd}''-]+'), lambda x: NOT regexp_matches(x, '^\\p{Nd}+$')) AS w FROM benchmark),
 g AS (SELECT id, grp, text, unnest(range(1, 6)) AS n, w FROM w), r AS (SELECT id, grp, text, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM g WHERE len(w) >= n),
 gram AS (SELECT id, grp, text, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM r),
 gdf AS (SELECT gram, count(DISTINCT id) AS gdf FROM gram GROUP BY 1)"""


@query("a08_global_ngram_frequency", f"WITH {GR} SELECT gram, gdf FROM gdf")
def a08(spark, d):
    return phrases.frequencies(bench(spark, d), "id", "text")


LOCAL = GR + ", loc AS (SELECT grp, gram, count(*) AS local FROM (SELECT DISTINCT grp, text, i, n, gram FROM gram) GROUP BY ALL)"


def grouped(spark, d):
    return bench(spark, d).withColumn("grp", F.col("id") % 4)


@query("a09_local_ngram_counts", f"WITH {LOCAL} SELECT grp, gram, local FROM loc")
def a09(spark, d):
    return phrases.local_counts(grouped(spark, d), "grp", "text")


STOPS = ",".join(f"'{w}'" for w in phrases.STOP_WORDS)
SCORED = LOCAL + f", sc AS (SELECT grp, gram, local, gdf, local * (ln(((SELECT count(*) FROM benchmark)::DOUBLE + 1) / (gdf + 1)) + 1) AS score FROM loc JOIN gdf USING (gram) WHERE local >= 2 AND regexp_matches(gram, '^\\p{{Lu}}') AND NOT list_bool_and([lower(x) IN ({STOPS}) FOR x IN string_split(gram, ' ')]))".replace("{{", "{").replace("}}", "}")


def key_scores(spark, d):
    b = grouped(spark, d)
    return phrases.scored(phrases.local_counts(b, "grp", "text"), phrases.frequencies(b, "id", "text"), b.count())


@query("x17_phrase_score", f"WITH {SCORED} SELECT grp, gram, round(score, 6) AS score FROM sc")
def x17(spark, d):
    return key_scores(spark, d).select("grp", "gram", F.round("score", 6).alias("score"))


def chosen_sql(top: int = 10) -> str:
    """The walk in ten steps: the first phrase of each group that is left, then without what it holds or is held by."""
    out = [SCORED, "s0 AS (SELECT grp, gram, score FROM sc)"]
    for k in range(1, top + 1):
        out.append(f"b{k} AS (SELECT grp, arg_min(gram, struct_pack(a := -round(score, 9), b := -len(string_split(gram, ' ')), c := gram)) AS best FROM s{k - 1} GROUP BY 1)")
        out.append(f"s{k} AS (SELECT s.* FROM s{k - 1} s JOIN b{k} USING (grp) WHERE NOT contains(gram, best) AND NOT contains(best, gram))")
    chosen = " UNION ALL ".join(f"SELECT grp, best AS gram FROM b{k}" for k in range(1, top + 1))
    return ", ".join(out) + f" SELECT grp, gram, round(score, 6) AS score FROM ({chosen}) JOIN s0 USING (grp, gram)"


@query("w13_m11_key_phrases", "WITH " + chosen_sql())
def w13(spark, d):
    return phrases.key_phrases(key_scores(spark, d), "grp").select("grp", "gram", F.round("score", 6).alias("score"))


def bilingual(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("english"), X.to_kana(F.col("p_name")).alias("japanese"), (F.col("p_size") % 3).alias("tier"))


KANA = "translate(lower({}), 'abcdefghijklmnopqrstuvwxyz ', 'アブクデエフグヒイジケルムノオパキラストウヴワズヤゼ・')"
PAIRS = f"""c AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ')) AS ws, list_distinct(string_split({KANA.format('p_name')}, '・')) AS rs FROM part),
 wn AS (SELECT word, count(*) AS word_n FROM (SELECT unnest(ws) AS word FROM c) GROUP BY 1), rn AS (SELECT run, count(*) AS run_n FROM (SELECT unnest(rs) AS run FROM c) GROUP BY 1),
 tg AS (SELECT word, run, count(*) AS together FROM (SELECT word, unnest(rs) AS run FROM (SELECT unnest(ws) AS word, rs FROM c)) GROUP BY ALL),
 dc AS (SELECT word, run, together, word_n, run_n, 2.0::DOUBLE * together / (word_n + run_n) AS dice FROM tg JOIN wn USING (word) JOIN rn USING (run))"""


def split_bilingual(spark, d):
    """Words separated by spaces on both sides, so that a run is a word's kana."""
    return bilingual(spark, d).withColumn("japanese", F.replace("japanese", F.lit("・"), F.lit(" ")))


@query("a10_co_occurrence", f"WITH {PAIRS} SELECT word, run, together, word_n, run_n, round(dice, 6) AS dice FROM dc")
def a10(spark, d):
    return mining.co_occurrence(mining.pair_words(split_bilingual(spark, d))).select("word", "run", "together", "word_n", "run_n", F.round("dice", 6).alias("dice"))


BEST = PAIRS + ", b1 AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(dice, 12) DESC, word) AS k FROM dc WHERE together >= 2), b2 AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY round(dice, 12) DESC, run) AS k2 FROM b1 WHERE k = 1 AND dice >= 0.45), best AS (SELECT word, run FROM b2 WHERE k2 = 1)"


@query("w11_best_dice", f"WITH {BEST} SELECT word, run FROM best")
def w11(spark, d):
    return mining.best_pairs(mining.co_occurrence(mining.pair_words(split_bilingual(spark, d)), mining.MIN_TOGETHER, mining.MIN_DICE)).select("word", "run")


@query("j18_witness_verification", f"WITH {BEST} SELECT word, run, count(*) AS witnesses FROM best JOIN c ON list_contains(ws, word) AND list_contains(rs, run) AND len(rs) <= 2 GROUP BY ALL")
def j18(spark, d):
    c = split_bilingual(spark, d)
    return mining.vouched(mining.best_pairs(mining.co_occurrence(mining.pair_words(c))).select("word", "run"), c)


@query("f19_m02_sentence_alignment")
def m02(spark, d):
    return mining.align(split_bilingual(spark, d))


def compound(spark, d):
    """Modifier in kanji stand-ins, then の, then the head's kana: a shape with a trailing katakana run."""
    head, mod = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    ja = F.concat(F.translate(mod, "abcdefghijklmnopqrstuvwxyz", "亜部区出絵負具飛位地毛留無野尾羽木良酢戸宇得輪図矢是"), F.lit("の"), X.to_kana(head))
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("english"), ja.alias("japanese"), (F.col("p_size") % 3).alias("tier"))


HEADS = f"""h AS (SELECT head, min(kana) AS reading, count(DISTINCT m) AS votes, min(t) AS tier FROM (SELECT split_part(p_name, ' ', 2) AS head, split_part(p_name, ' ', 1) AS m, {KANA.format("split_part(p_name, ' ', 2)")} AS kana, p_size % 3 AS t FROM part) GROUP BY 1 HAVING count(DISTINCT m) >= 3)"""


@query("a11_head_lexicon", f"WITH {HEADS} SELECT head, reading, votes, tier FROM h WHERE length(reading) >= 2")
def a11(spark, d):
    return mining.heads(compound(spark, d)).select("head", "reading", "votes", "tier")


MODS = HEADS + ", m AS (SELECT m AS modifier, translate(m, 'abcdefghijklmnopqrstuvwxyz', '亜部区出絵負具飛位地毛留無野尾羽木良酢戸宇得輪図矢是') AS rendering, min(t) AS tier FROM (SELECT split_part(p_name, ' ', 2) AS head, split_part(p_name, ' ', 1) AS m, p_size % 3 AS t FROM part) JOIN h USING (head) GROUP BY 1, 2 HAVING count(DISTINCT head) >= 2)"


@query("a12_m03_modifier_lexicon", f"WITH {MODS} SELECT modifier, rendering, tier FROM m")
def a12(spark, d):
    c = compound(spark, d)
    return mining.modifiers(c, mining.heads(c)).select("modifier", "rendering", "tier")


SPELLED = f"sp AS (SELECT lower(p_type) AS word, {KANA.format('p_type')} AS kana, min(p_size % 2) AS tier FROM part GROUP BY ALL)"


def spelled_types(spark, d):
    """Types of parts as words that only their spelling translates."""
    return table(spark, d, "part").groupBy(F.lower("p_type").alias("word"), X.to_kana(F.col("p_type")).alias("kana")).agg(F.min(F.col("p_size") % 2).alias("tier"))


@query("m04_meaning_composition", f"""WITH {MODS}, {SPELLED}, x AS (SELECT p_partkey, split_part(p_name, ' ', 2) AS head, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE lower(p_type) END AS modifier FROM part)
 SELECT p_partkey, coalesce(m.rendering, kana) || 'の' || reading AS japanese, CASE WHEN coalesce(m.rendering, kana) || reading IS NULL THEN NULL WHEN m.rendering IS NOT NULL THEN 'SJPTS_AutoCorpusMeaning' ELSE 'SJPTS_AutoCorpusMeaningTranslit' END AS method
 FROM x LEFT JOIN h USING (head) LEFT JOIN m ON m.modifier = x.modifier LEFT JOIN sp ON sp.word = x.modifier""")
def m04(spark, d):
    c = compound(spark, d)
    h = mining.heads(c)
    p = table(spark, d, "part").withColumn("t", F.expr("CASE WHEN p_size % 2 = 0 THEN p_name ELSE lower(p_type) || ' ' || split_part(p_name, ' ', 2) END"))
    return mining.compose(p, "t", h, mining.modifiers(c, h), spelled_types(spark, d)).select("p_partkey", "meaning.japanese", "meaning.method")


def named(spark, d):
    """Names of parts with their readings, and running text that uses the first words of some in lower case."""
    c = bilingual(spark, d)
    names = c.select("row_id", F.initcap("english").alias("english"), "japanese")
    running = c.where("english < 'd'").select((F.col("row_id") + 1_000_000_000_000).alias("row_id"), F.concat(F.lit("Keep it "), F.split_part("english", F.lit(" "), F.lit(1))).alias("english"), F.lit("話").alias("japanese"))
    return names.unionByName(running)


# A row teaches the words that no earlier row has; only where it is the first to have either of its two words is it taken whole.
@query("m01_dictionary_induction", f"""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), first AS (SELECT word, min(p_partkey) AS row FROM (SELECT p_partkey, unnest(w) AS word FROM w) GROUP BY 1),
 whole AS (SELECT array_to_string(w, ' ') AS word FROM w JOIN first a ON a.word = w[1] JOIN first b ON b.word = w[2] WHERE a.row = p_partkey AND b.row = p_partkey),
 small AS (SELECT DISTINCT w[1] AS word FROM w WHERE w[1] < 'd')
 SELECT word, {KANA.format('word')} AS kana FROM (SELECT word FROM first UNION SELECT word FROM whole) WHERE word NOT IN (SELECT word FROM small)""")
def m01(spark, d):
    return induction.induce(named(spark, d)).select("word", "kana")


def known_pieces(spark, d):
    """The words of part names as pieces; words of five letters or more may stand alone."""
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", X.to_kana(F.col("word")).alias("kana"), F.lit("part").alias("source"), (F.char_length("word") >= 5).alias("alone"))


@query("m05_m06_decomposition", f"""WITH n AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size % 3 AS k FROM part),
 t AS (SELECT k, a, b, CASE k WHEN 0 THEN a || b WHEN 1 THEN upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] || a ELSE a || 'qqx' END AS name FROM n),
 r AS (SELECT name, CASE k WHEN 0 THEN {KANA.format('a')} || {KANA.format('b')} WHEN 1 THEN {KANA.format('a')} || '・' || {KANA.format('b')} || {KANA.format('a')} END AS japanese, k, a FROM t)
 SELECT DISTINCT name, japanese FROM r WHERE k = 0 OR k = 1 AND length(a) >= 5""")
def m05(spark, d):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    name = F.when(F.col("p_size") % 3 == 0, F.concat(a, b)).when(F.col("p_size") % 3 == 1, F.concat(F.initcap(a), F.lit(" "), F.initcap(b), a)).otherwise(F.concat(a, F.lit("qqx")))
    return spelling.transliterate(table(spark, d, "part").select(name.alias("name")), known_pieces(spark, d)).select("name", "japanese")


CHAIN_WORDS = {"name": "CASE p_size % 5 WHEN 0 THEN '[T] ' || A || ' ' || B WHEN 1 THEN B || ' of the ' || A WHEN 2 THEN A || ' and ' || B || 's' WHEN 3 THEN B || ' No ' || A ELSE A || '-' || B || ' Qux' END"}


@query("m07_name_chain", f"""WITH p AS (SELECT p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), q AS (SELECT *, upper(a[1]) || a[2:] AS A_, upper(b[1]) || b[2:] AS B_ FROM p),
 t AS (SELECT DISTINCT p_size % 5 AS k, {KANA.format('a')} AS x, {KANA.format('b')} AS y, {CHAIN_WORDS['name'].replace('A ||', 'A_ ||').replace('|| A ', '|| A_ ').replace('|| A)', '|| A_)').replace("B ||", "B_ ||").replace("|| B ", "|| B_ ")} AS name FROM q)
 SELECT name, CASE k WHEN 0 THEN '[T] ' || x || 'の' || y WHEN 1 THEN x || 'の' || y WHEN 2 THEN x || 'と' || y WHEN 3 THEN y || ' （' || x || 'なし）' END AS japanese, CASE k WHEN 4 THEN 'Qux' ELSE '' END AS missing FROM t""")
def m07(spark, d):
    p = table(spark, d, "part").select("p_size", F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("A"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("B"))
    w = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct().select("word", X.to_kana(F.col("word")).alias("japanese"), F.lit("part").alias("source"))
    early = F.col("word") < "m"
    words = names.lexicon(exact=w.where(early), glossary=w.where(~early))
    out = names.translate(p.select(F.expr(CHAIN_WORDS["name"]).alias("name")), words)
    return out.select("name", "japanese", F.array_join("missing", " ").alias("missing"))


CASE_TEXT = """CASE p_size % 5 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN upper(substr(b, 1, 1)) || substr(b, 2) || ' and ' || upper(substr(a, 1, 1)) || substr(a, 2) ELSE p_name || ' #' || p_size END"""
CASCADE = f"""WITH {MODS}, part2 AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), c AS (SELECT *, {CASE_TEXT} AS t FROM part2),
 e AS (SELECT p_name || ' ' || p_brand AS key, arg_min(p_type, p_partkey) AS ja FROM part GROUP BY 1),
 r AS (SELECT p_partkey, t, CASE WHEN p_partkey % 7 = 0 THEN 'preserved' WHEN p_partkey % 5 = 0 THEN 'covered' WHEN p_partkey % 11 = 0 THEN 'cross_mod' WHEN p_size % 5 = 0 THEN 'exact'
   WHEN p_size % 5 = 1 AND reading IS NOT NULL AND rendering IS NOT NULL THEN 'meaning' WHEN p_size % 5 = 2 THEN 'transliteration' WHEN p_size % 5 = 3 THEN 'name_fallback'
   WHEN length(t) % 2 = 0 THEN 'local_llm' WHEN length(t) % 3 = 0 THEN 'cloud_llm' ELSE 'unresolved' END AS stage,
   rendering || 'の' || reading AS composed, ja, {KANA.format('a')} AS x, {KANA.format('b')} AS y, a IN ('red', 'blue', 'green') AS colour FROM c LEFT JOIN h ON head = b LEFT JOIN m ON modifier = a LEFT JOIN e ON key = t)
 SELECT p_partkey, stage, CASE stage WHEN 'preserved' THEN 'kept' WHEN 'covered' THEN '既' WHEN 'cross_mod' THEN '他' WHEN 'exact' THEN ja WHEN 'meaning' THEN composed WHEN 'transliteration' THEN x || y WHEN 'name_fallback' THEN CASE WHEN colour THEN y || ' （' || x || '）' ELSE y || 'と' || x END
   WHEN 'local_llm' THEN '近' || t WHEN 'cloud_llm' THEN '遠' || t ELSE '' END AS japanese,
   CASE stage WHEN 'preserved' THEN 'SJPTS_ModifiedByUser' WHEN 'covered' THEN 'SJPTS_AutoCorpusDsd' WHEN 'cross_mod' THEN 'SJPTS_AutoCrossModPrecedent' WHEN 'exact' THEN 'SJPTS_AutoCorpus' WHEN 'meaning' THEN 'SJPTS_AutoCorpusMeaning' WHEN 'transliteration' THEN 'SJPTS_AutoCorpusTransliterate'
   WHEN 'name_fallback' THEN 'SJPTS_TranslationNameFallback' WHEN 'local_llm' THEN 'SJPTS_TranslationLocalLlm' WHEN 'cloud_llm' THEN 'SJPTS_TranslationCloudLlm' ELSE '' END AS method FROM r"""


def cascaded(spark, d, on=None):
    """All stages over all parts; the texts are made so that each stage has rows that only it answers."""
    p = table(spark, d, "part").withColumns({"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2))})
    r = p.select("p_partkey", F.expr(CASE_TEXT).alias("text"), F.lit("WEAP FULL").alias("record_type"))
    spelled = p.select(F.concat("p_name", F.lit(" "), "p_brand").alias("english"), F.col("p_partkey").alias("row_id"), F.col("p_type").alias("japanese"), F.lit("vanilla").alias("kind"), F.lit("WEAP FULL").alias("type"))
    exact = corpus.exact_dictionary(spelled, spark.createDataFrame([], "key string"), spark.createDataFrame([], "english string, japanese string"))
    c = compound(spark, d)
    h = mining.heads(c)
    w = known_pieces(spark, d)
    words = names.lexicon(exact=w.select("word", F.col("kana").alias("japanese"), "source"))
    answer = lambda condition, ja: F.expr(f"CASE WHEN {condition} THEN {ja} END")
    stages = {
        "preserved": cascade.column_stage(answer("p_partkey % 7 = 0", "'kept'"), "SJPTS_ModifiedByUser"),
        "covered": cascade.column_stage(answer("p_partkey % 5 = 0", "'既'"), "SJPTS_AutoCorpusDsd"),
        "cross_mod": cascade.column_stage(answer("p_partkey % 11 = 0", "'他'"), "SJPTS_AutoCrossModPrecedent"),
        "exact": lambda rows: corpus.exact_lookup(rows, exact).withColumn("answer", cascade.told(F.col("exact.japanese"), F.col("exact.method"))),
        "meaning": cascade.meaning_stage("text", "record_type", h, mining.modifiers(c, h), spelled_types(spark, d)),
        "transliteration": cascade.spelling_stage("text", "record_type", w.withColumn("alone", F.lit(False))),
        "name_fallback": cascade.name_stage("text", "record_type", words),
        "local_llm": cascade.column_stage(answer("length(text) % 2 = 0", "'近' || text"), "SJPTS_TranslationLocalLlm"),
        "cloud_llm": cascade.column_stage(answer("length(text) % 3 = 0", "'遠' || text"), "SJPTS_TranslationCloudLlm"),
    }
    return cascade.run(r, stages, on)


@query("m08_resolution_cascade", CASCADE)
def m08(spark, d):
    return cascaded(spark, d).select("p_partkey", "stage", "japanese", "method")


@query("m08_stage_counts", f"WITH z AS ({CASCADE}) SELECT stage, method, count(*) AS rows FROM z GROUP BY ALL")
def m08_counts(spark, d):
    return cascade.stage_counts(cascaded(spark, d))


class Marked:
    """A stand-in translator: answers every second text by itself with a mark before it."""

    def translate(self, texts, hints, timeout):
        return {t: f"訳{t}" for t in texts if len(t) % 2 == 0}


@query("b01_batch_translation", "SELECT DISTINCT p_brand, p_name, '訳' || p_name AS japanese FROM part WHERE length(p_name) % 2 = 0")
def b01(spark, d):
    return rounds.translate(table(spark, d, "part"), "p_brand", "p_name", Marked)
