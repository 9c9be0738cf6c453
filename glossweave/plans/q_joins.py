"""Queries of the join operators. ``part`` stands for candidates (plugin = brand, type, text = name)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batch, cascade, corpus, coverage, iface, mining, reports
from .registry import query, table


def records(spark, d):
    p = table(spark, d, "part")
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'GMST DATA' WHEN 1 THEN 'QUST CNAM' ELSE 'WEAP FULL' END")
    return p.select("p_partkey", F.col("p_brand").alias("plugin"), kind.alias("record_type"), F.col("p_size").cast("string").alias("form_id"), (F.col("p_partkey") % 10).alias("index"), F.col("p_name").alias("editor_id"), F.col("p_name").alias("text"))


def entries(spark, d):
    """Patch entries from one part in four, spelled in upper case where the key ignores case."""
    p = table(spark, d, "part").where("p_partkey % 4 = 0 or p_size < 10")
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'GMST DATA' WHEN 1 THEN 'QUST CNAM' ELSE 'WEAP FULL' END")
    return p.select(kind.alias("type"), F.col("p_size").cast("string").alias("form_id"), (F.col("p_partkey") % 10).alias("index"), F.upper("p_name").alias("editor_id"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_name || ' old' ELSE p_name END").alias("original"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE '剣' || p_partkey END").alias("string"), F.expr("CASE WHEN p_partkey % 8 = 0 THEN 'SJPTS_x' ELSE 'ext' END").alias("status"), F.col("p_partkey").alias("entry_no"))


COVER_SQL = """WITH r AS (SELECT p_partkey, p_brand AS plugin, p_partkey % 3 AS m, p_size, p_partkey % 10 AS idx, p_name FROM part),
 e AS (SELECT p_partkey AS no, p_partkey % 3 AS m, p_size, p_partkey % 10 AS idx, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' old' ELSE p_name END AS original, CASE WHEN p_partkey % 7 = 0 THEN p_type ELSE '剣' || p_partkey END AS string, p_partkey % 8 = 0 AS own FROM part WHERE p_partkey % 4 = 0 OR p_size < 10),
 k AS (SELECT *, CASE m WHEN 0 THEN 'E' || lower(p_name) WHEN 1 THEN 'T' || p_size || '|' || original ELSE 'I' || p_size || '|' || idx END AS key FROM e),
 f AS (SELECT key, arg_min(original, no) AS original, arg_min(string, no) AS string, arg_min(own, no) AS own FROM k GROUP BY key),
 j AS (SELECT r.*, f.key IS NOT NULL AS hit, f.original, f.string, coalesce(f.own, false) AS own FROM r LEFT JOIN f ON f.key = CASE r.m WHEN 0 THEN 'E' || lower(r.p_name) WHEN 1 THEN 'T' || r.p_size || '|' || r.p_name ELSE 'I' || r.p_size || '|' || r.idx END),
 g AS (SELECT *, hit AND (own OR starts_with(string, '剣')) AS cov FROM j)
"""


@query("j01_coverage_lookup", COVER_SQL + "SELECT p_partkey, string, cov AS is_covered FROM g")
def j01(spark, d):
    j = coverage.judge(coverage.lookup(records(spark, d), entries(spark, d)))
    return j.select("p_partkey", F.col("covered.string").alias("string"), "is_covered")


@query("j02_stale_detection", COVER_SQL + "SELECT p_partkey, original, cov AND NOT own AND original <> p_name AS is_stale FROM g WHERE cov")
def j02(spark, d):
    j = coverage.judge(coverage.lookup(records(spark, d), entries(spark, d)))
    return j.where("is_covered").select("p_partkey", F.col("covered.original").alias("original"), "is_stale")


@query("j03_own_decision", COVER_SQL + "SELECT p_partkey FROM g WHERE own")
def j03(spark, d):
    return coverage.judge(coverage.lookup(records(spark, d), entries(spark, d))).where("own").select("p_partkey")


ROLL = """SELECT coalesce(c.plugin, u.plugin) AS plugin, coalesce(c.n, 0) AS translated, coalesce(u.n, 0) AS untranslated, coalesce(c.ch, 0) AS translated_chars, coalesce(u.ch, 0) AS untranslated_chars, coalesce(u.sample, '') AS sample,
 coalesce(c.n, 0) + coalesce(u.n, 0) AS total, round(100.0 * coalesce(c.n, 0) / (coalesce(c.n, 0) + coalesce(u.n, 0)), 6) AS ratio, round(100.0 * coalesce(c.ch, 0) / (coalesce(c.ch, 0) + coalesce(u.ch, 0)), 6) AS chars_ratio
 FROM (SELECT plugin, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS ch FROM g WHERE cov GROUP BY 1) c
 FULL JOIN (SELECT plugin, count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS ch, array_to_string(list_slice(list(p_name ORDER BY p_partkey), 1, 3), ' / ') AS sample FROM g WHERE NOT cov OR own GROUP BY 1) u ON c.plugin = u.plugin"""


@query("a01_coverage_rollup", COVER_SQL + ROLL)
def a01(spark, d):
    j = coverage.judge(coverage.lookup(records(spark, d), entries(spark, d)))
    return coverage.roll_up(j, F.col("is_covered"), ~F.col("is_covered") | F.col("own"), "plugin", "text", "p_partkey")


@query("j05_exact_lookup", """WITH c AS (SELECT p_name AS key, arg_min(p_brand, struct_pack(t := CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, r := p_partkey)) AS ja, arg_min(p_size % 4, struct_pack(t := CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, r := p_partkey)) AS k, bool_or(p_type = 'PROMO') AS npc FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
 SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 <> 0 OR c.npc THEN c.ja END AS japanese, CASE WHEN c.key IS NOT NULL AND (p.p_partkey % 3 <> 0 OR c.npc) THEN CASE c.k WHEN 0 THEN 'SJPTS_AutoCorpus' WHEN 1 THEN 'SJPTS_AutoCorpusReferenceTaiyaku' WHEN 2 THEN 'SJPTS_AutoCorpusDsd' ELSE 'SJPTS_AutoCorpusImported' END END AS method
 FROM part p LEFT JOIN c ON c.key = p.p_name""")
def j05(spark, d):
    dic = exact(spark, d, "p_partkey % 2 = 0")
    r = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'NPC_ FULL' ELSE 'WEAP FULL' END").alias("record_type"))
    return corpus.exact_lookup(r, dic).select("p_partkey", "exact.japanese", "exact.method")


def exact(spark, d, where: str):
    p = table(spark, d, "part").where(where)
    c = p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("english"), F.col("p_brand").alias("japanese"), F.expr("CASE p_size % 4 WHEN 0 THEN 'vanilla' WHEN 1 THEN 'reference' WHEN 2 THEN 'dsd' ELSE 'imported' END").alias("kind"), F.expr("CASE WHEN p_type = 'PROMO' THEN 'NPC_ FULL' ELSE 'WEAP FULL' END").alias("type"))
    none = spark.createDataFrame([], "key string")
    return corpus.exact_dictionary(c, none, spark.createDataFrame([], "english string, japanese string"))


@query("a13_exact_dictionary", """SELECT key, CASE WHEN key = 'red ring' THEN '赤い指輪' ELSE ja END AS japanese, CASE WHEN key = 'red ring' THEN -1 ELSE t END AS tier FROM (SELECT p_name AS key, arg_min(p_brand, struct_pack(t := CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, r := p_partkey)) AS ja, min(CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS t FROM part WHERE p_name <> 'small ring' GROUP BY 1
 UNION SELECT 'red ring', '', 9 WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_name = 'red ring'))""")
def a13(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("english"), F.col("p_brand").alias("japanese"), F.expr("CASE p_size % 4 WHEN 0 THEN 'vanilla' WHEN 1 THEN 'reference' WHEN 2 THEN 'dsd' ELSE 'imported' END").alias("kind"), F.lit("WEAP FULL").alias("type"))
    return corpus.exact_dictionary(c, spark.createDataFrame([("small ring",)], "key string"), spark.createDataFrame([("red ring", "赤い指輪")], "english string, japanese string")).select("key", "japanese", "tier")


IMPORTED = "l_partkey % 50 AS plugin, l_returnflag AS type, CAST(l_partkey % 97 AS {s}) AS english, CASE WHEN l_linestatus = 'O' THEN '剣' || l_suppkey ELSE 'x' END AS japanese"


@query("j06_import_semi_join", f"""SELECT plugin, type, english, japanese FROM (SELECT *, row_number() OVER (PARTITION BY plugin, type, english ORDER BY l_orderkey DESC, japanese DESC) AS n FROM (SELECT l_orderkey, {IMPORTED.format(s='VARCHAR')} FROM lineitem) WHERE starts_with(japanese, '剣') AND (type, english) IN (SELECT 'R', CAST(p_size AS VARCHAR) FROM part)) WHERE n = 1""")
def j06(spark, d):
    imp = table(spark, d, "lineitem").selectExpr(*[e for e in ("l_partkey % 50 AS plugin", "l_returnflag AS type", "CAST(l_partkey % 97 AS STRING) AS english", "CASE WHEN l_linestatus = 'O' THEN '剣' || l_suppkey ELSE 'x' END AS japanese", "l_orderkey AS file_rank")])
    imp = imp.withColumn("row_id", F.col("japanese"))
    cand = table(spark, d, "part").select(F.lit("R").alias("type"), F.col("p_size").cast("string").alias("english"))
    return corpus.import_entries(imp, cand)


@query("f32_version_mismatch", "SELECT plugin, count(*) AS entries, count(*) FILTER (english < 5) AS matched FROM (SELECT l_partkey % 50 AS plugin, l_partkey % 97 AS english FROM lineitem) GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (english < 5) < 0.1 * count(*)")
def f32(spark, d):
    imp = table(spark, d, "lineitem").selectExpr("l_partkey % 50 AS plugin", "'R' AS type", "CAST(l_partkey % 97 AS STRING) AS english")
    cand = spark.range(5).select(F.lit("R").alias("type"), F.col("id").cast("string").alias("english"))
    return corpus.mismatched_imports(imp, cand)


@query("j07_carry_forward", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'ja' || p_partkey END AS japanese FROM part")
def j07(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    old = p.where("p_partkey % 2 = 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 3 = 0 THEN text || '!' ELSE text END").alias("text"), F.concat(F.lit("ja"), "p_partkey").alias("japanese"), F.lit("m").alias("method"))
    return cascade.carry_forward(p, old, ["p_partkey"], F.col("old_text") == F.col("text")).select("p_partkey", "kept.japanese")


@query("j09_name_hits", "SELECT doc_id, count(DISTINCT lower(w)) AS hits FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) >= 3 AND lower(w) IN (SELECT lower(w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark WHERE item_id % 4 = 0) WHERE length(w) >= 3) GROUP BY doc_id")
def j09(spark, d):
    w = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(F.transform(F.filter(F.split("text", " "), lambda x: F.char_length(x) >= 3), F.lower))).alias("w"))
    names = w(table(spark, d, "benchmark").where("item_id % 4 = 0")).distinct()
    return w(table(spark, d, "documents"), "doc_id").join(names, "w", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("j10_brand_hits", "SELECT p_partkey, array_to_string(list_sort(list_filter(string_split(lower(p_name), ' '), lambda w: list_contains(['red', 'ring', 'widget'], w))), ' ') AS hits FROM part")
def j10(spark, d):
    brand = F.array(*[F.lit(w) for w in ("red", "ring", "widget")])
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split(F.lower("p_name"), " "), brand)), " ").alias("hits"))


@query("j11_plugin_summary", "WITH c AS (SELECT p_brand AS plugin, count(*) FILTER (p_size > 25) AS translated, count(*) AS total FROM part GROUP BY 1), r AS (SELECT p_brand, count(*) FILTER (p_size <= 10) AS resolved, count(*) FILTER (p_size BETWEEN 11 AND 25) AS remaining FROM part WHERE p_type = 'PROMO' OR p_type = 'STANDARD' GROUP BY 1) SELECT plugin, translated, total, coalesce(resolved, 0) AS resolved, coalesce(remaining, 0) AS remaining, round(100.0 * (translated + coalesce(resolved, 0)) / total, 6) AS final_ratio FROM c LEFT JOIN r ON plugin = p_brand")
def j11(spark, d):
    p = table(spark, d, "part")
    c = p.groupBy(F.col("p_brand").alias("plugin")).agg(F.count_if(F.col("p_size") > 25).alias("translated"), F.count(F.lit(1)).alias("total"))
    r = p.where("p_type in ('PROMO', 'STANDARD')").groupBy(F.upper("p_brand").alias("plugin")).agg(F.count_if(F.col("p_size") <= 10).alias("resolved"), F.count_if(F.col("p_size").between(11, 25)).alias("remaining"))
    return reports.plugin_summary(c, r)


@query("j12_glossary_upsert", "SELECT coalesce(e.n_name, x.n_name) AS word, coalesce(e.ja, '') AS japanese, coalesce(x.n, 0) AS n FROM (SELECT n_name, 'ja' || n_nationkey AS ja FROM nation WHERE n_nationkey % 2 = 0) e FULL JOIN (SELECT n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY 1) x ON e.n_name = x.n_name")
def j12(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    e = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("word"), F.concat(F.lit("ja"), "n_nationkey").alias("japanese"))
    x = n.where("n_nationkey % 3 = 0").join(s, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return reports.upsert(e, x, "word", "japanese", ["n"])


@query("j13_has_content_flag", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AS has_content FROM nation")
def j13(spark, d):
    m = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("string").alias("k"))
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    return reports.flag_members(n, m, "k", "has_content").select("n_nationkey", "has_content")


@query("j14_race_names", "SELECT c_custkey, r.r_name || ' ' || n.n_name AS context FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN (SELECT r_regionkey, max(r_name) AS r_name FROM region GROUP BY 1) r ON n.n_regionkey = r.r_regionkey")
def j14(spark, d):
    r = table(spark, d, "region").groupBy("r_regionkey").agg(F.max_by("r_name", "r_name").alias("r_name"))
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(" ", "r_name", "n_name").alias("context"))


@query("j15_interface_merge", "SELECT p_brand AS base, CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 5 = 0 THEN 'new' || p_partkey WHEN p_partkey % 2 = 0 THEN 'old' || p_partkey END AS japanese FROM part")
def j15(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("base"), F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("english"))
    old = p.where("int(key) % 2 = 0").select(F.upper("base").alias("base"), "key", F.concat(F.lit("old"), "key").alias("japanese"))
    new = p.where("int(key) % 5 = 0").select("base", "key", F.concat(F.lit("new"), "key").alias("japanese"))
    return iface.merge(p, old, new).select("base", "key", "japanese")


@query("j16_prefix_fallback", "WITH t AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE substr(s_name, 1, length(s_name) - 1) END AS target FROM supplier) SELECT target, coalesce((SELECT min(s_name) FROM supplier WHERE lower(s_name) = lower(target)), (SELECT min(s_name) FROM supplier WHERE starts_with(lower(s_name), lower(target)))) AS file FROM t")
def j16(spark, d):
    s = table(spark, d, "supplier")
    t = s.select(F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE substr(s_name, 1, length(s_name) - 1) END").alias("target")).distinct()
    return iface.prefix_match(t, s.select(F.col("s_name").alias("name")))


@query("f29_interface_resolution", "SELECT p_partkey, (p_partkey % 4 = 0 OR p_partkey % 4 = 1 OR p_partkey % 4 = 2) AS resolved FROM part")
def f29(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN '$' || upper(p_name) ELSE '$k' END").alias("key"), F.expr("CASE WHEN p_partkey % 4 = 1 THEN '123' ELSE p_name END").alias("english"), F.expr("CASE WHEN p_partkey % 4 = 2 THEN '剣' END").alias("japanese"))
    return iface.resolve(p).select("p_partkey", "resolved")


@query("j19_official_set", "SELECT p_name AS word, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name")
def j19(spark, d):
    p = table(spark, d, "part").withColumn("ja", X.to_kana(F.col("p_name")))
    dic = p.select(F.col("p_name").alias("word"), F.col("ja").alias("kana")).distinct()
    c = p.where("p_partkey % 2 = 0").select(F.col("p_name").alias("english"), F.col("ja").alias("japanese"), F.col("p_brand").alias("source"))
    return mining.official(dic, c).select("word", F.array_join("sources", ",").alias("sources"))


@query("j20_answer_match_back", "SELECT p_partkey, 'ja' || p_partkey AS japanese FROM part")
def j20(spark, d):
    """Exact, then trimmed, then without quotes: three joins of which the first hit counts."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey")).alias("text"))
    a = p.select(F.expr("CASE p_partkey % 3 WHEN 0 THEN text WHEN 1 THEN '  ' || text ELSE '\"' || text || '\"' END").alias("k"), F.concat(F.lit("ja"), "p_partkey").alias("japanese"))
    forms = [a.select(f.alias("text"), F.col("japanese").alias(f"a{i}")).dropDuplicates(["text"]) for i, f in enumerate((F.col("k"), F.trim("k"), F.regexp_replace(F.trim("k"), '^"(.*)"$', "$1")))]
    for f in forms:
        p = p.join(f, "text", "left")
    return p.select("p_partkey", F.coalesce("a0", "a1", "a2").alias("japanese"))


@query("j21_extra_hints", "SELECT n_name AS english, 'own' AS japanese FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_name, 'extra' FROM nation WHERE n_nationkey BETWEEN 10 AND 20")
def j21(spark, d):
    n = table(spark, d, "nation")
    own = n.where("n_nationkey < 10").select(F.col("n_name").alias("english"), F.lit("own").alias("japanese"))
    return corpus.merge_hints(own, n.where("n_nationkey between 5 and 20").select(F.col("n_name").alias("english"), F.lit("extra").alias("japanese")))


@query("j22_word_glossary", "SELECT p_partkey, w AS word, CASE WHEN w IN ('ring', 'red') THEN 'exact' ELSE 'meaning' END AS origin FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) >= 3 AND w IN ('ring', 'red', 'small', 'widget')")
def j22(spark, d):
    lex = lambda *w: spark.createDataFrame([(x, "ja") for x in w], "word string, japanese string")
    return cascade.word_glossary(table(spark, d, "part"), "p_partkey", "p_name", [("exact", lex("ring", "red")), ("meaning", lex("red", "small", "widget"))]).select("p_partkey", "word", "origin")


@query("j23_k16_human_edits", "SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'edited' ELSE p_name END AS japanese, CASE WHEN p_partkey % 6 = 0 THEN 'SJPTS_ModifiedByUser' ELSE p_type END AS notes, p_brand FROM part")
def j23(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("japanese"), F.col("p_type").alias("notes"), F.lit("AllJapanese").alias("translation_check"), "p_brand")
    edits = p.where("p_partkey % 3 = 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 6 = 0 THEN 'edited' ELSE japanese END").alias("japanese"))
    return reports.apply_edits(p, edits, ["p_partkey"]).select("p_partkey", "japanese", "notes", "p_brand")


@query("a19_text_fan_out", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part")
def a19(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return batch.fan_out(p, reports.group_by_text(p, "p_name", "p_partkey").select("p_name", "n"), ["p_name"])


@query("f24_subset_filter", "SELECT s_suppkey FROM supplier WHERE lower(s_name) IN (SELECT lower(s_name) FROM supplier WHERE s_suppkey % 10 = 0)")
def f24(spark, d):
    s = table(spark, d, "supplier")
    want = s.where("s_suppkey % 10 = 0").select(F.upper("s_name").alias("k"))
    return s.join(want, F.upper("s_name") == F.col("k"), "left_semi").select("s_suppkey")
