"""Queries of roll-ups, set operations and ordered views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import cascade, corpus, iface, overlay, reports
from ..sources import sinks
from .registry import query, table


@query("a02_auto_resolve_rollup", "SELECT p_brand, count(*) AS total, count(*) FILTER (p_size > 25) AS resolved, count(*) FILTER (NOT p_size > 25) AS remaining, CAST(sum(CASE WHEN p_size > 25 THEN 0 ELSE length(p_name) END) AS BIGINT) AS remaining_chars FROM part GROUP BY 1")
def a02(spark, d):
    return reports.auto_resolve(table(spark, d, "part"), "p_brand", F.col("p_size") > 25, "p_name")


@query("a03_translation_stats", "SELECT p_type, count(*) AS total, count(*) FILTER (p_size <= 25) AS untranslated, round(100.0 * count(*) FILTER (p_size <= 25) / count(*), 6) AS pct, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part GROUP BY 1")
def a03(spark, d):
    n = F.count_if(F.col("p_size") <= 25)
    return table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("total"), n.alias("untranslated"), F.round(X.percent(n, F.count(F.lit(1)), 0.0), 6).alias("pct"), F.sum(F.char_length("p_name")).cast("long").alias("chars"))


METHOD = "CASE p_size % 7 WHEN 0 THEN 'SJPTS_AutoCorpus' WHEN 1 THEN 'SJPTS_AutoCorpusDsd' WHEN 2 THEN 'SJPTS_AutoCorpusMeaningTranslit' WHEN 3 THEN 'SJPTS_AutoCorpusTransliterate' WHEN 4 THEN 'SJPTS_AutoCrossModPrecedent' WHEN 5 THEN 'SJPTS_TranslationNameFallback' ELSE 'SJPTS_TranslationLocalLlm' END"


@query("a04_method_pivot", "SELECT p_brand, count(*) FILTER (p_size % 7 IN (0, 1)) AS exact, count(*) FILTER (p_size % 7 = 2) AS meaning, count(*) FILTER (p_size % 7 = 3) AS transliteration, count(*) FILTER (p_size % 7 = 4) AS cross_mod, count(*) FILTER (p_size % 7 = 5) AS fallback, count(*) FILTER (p_size % 7 = 6) AS llm FROM part GROUP BY 1")
def a04(spark, d):
    return cascade.method_pivot(table(spark, d, "part").withColumn("method", F.expr(METHOD)), "p_brand")


@query("f31_hint_eligibility", f"SELECT p_partkey, method, CASE method WHEN 'SJPTS_AutoCorpusMeaningTranslit' THEN 3 WHEN 'SJPTS_AutoCorpusTransliterate' THEN 4 WHEN 'SJPTS_AutoCrossModPrecedent' THEN 5 WHEN 'SJPTS_TranslationLocalLlm' THEN 7 ELSE 8 END AS priority FROM (SELECT p_partkey, {METHOD} AS method FROM part) WHERE method NOT IN ('SJPTS_AutoCorpus', 'SJPTS_AutoCorpusDsd')")
def f31(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(METHOD).alias("method"))
    return p.withColumn("priority", cascade.hint_priority(F.col("method"))).where("priority is not null")


@query("a05_source_summary", """WITH g AS (SELECT p_type AS key, p_brand AS kind, CAST(p_size % 3 AS VARCHAR) AS source, count(*) AS n FROM part GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, kind, source) AS k FROM g)
 SELECT key, string_agg(kind || ':' || source || '×' || n, ', ' ORDER BY k) FILTER (k <= 4) || CASE WHEN sum(n) FILTER (k > 4) > 0 THEN ', other ' || CAST(sum(n) FILTER (k > 4) AS BIGINT) ELSE '' END AS summary FROM r GROUP BY key""")
def a05(spark, d):
    p = table(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("kind"), (F.col("p_size") % 3).cast("string").alias("source"))
    return corpus.source_summary(p, "key")


KIND = "CASE p_size % 5 WHEN 0 THEN 'vanilla' WHEN 1 THEN 'reference' WHEN 2 THEN 'dsd' WHEN 3 THEN 'override' ELSE 'cross_mod' END"
TIER = f"CASE {KIND} WHEN 'vanilla' THEN 0 WHEN 'reference' THEN 1 WHEN 'override' THEN -1 ELSE 2 END"


@query("a06_best_tier", f"SELECT p_name, min({TIER}) AS tier FROM part GROUP BY 1")
def a06(spark, d):
    return corpus.best_tier(table(spark, d, "part").withColumn("kind", F.expr(KIND)), ["p_name"])


@query("x23_source_tier", f"SELECT p_partkey, {TIER} AS tier FROM part")
def x23(spark, d):
    return table(spark, d, "part").select("p_partkey", corpus.tier(F.expr(KIND)).alias("tier"))


@query("a14_blocking_words", "SELECT w AS word, count(*) AS blocked, arg_min(p_name, p_partkey) AS example FROM (SELECT DISTINCT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def a14(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("text"), F.split("p_name", " ").alias("missing"))
    return cascade.blockers(p)


@query("a16_k14_detail_counts", "SELECT *, count(*) OVER (PARTITION BY category) AS kinds FROM (SELECT o_orderstatus AS category, o_orderpriority AS item, count(*) AS n FROM orders GROUP BY ALL)")
def a16(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("item"))
    return sinks.grouped_list(o, "category", "item")


@query("a17_global_totals", "SELECT count(*) AS n, CAST(sum(length(p_name)) AS BIGINT) AS chars, max(p_size) AS biggest FROM part")
def a17(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("p_name")).cast("long").alias("chars"), F.max("p_size").alias("biggest"))


@query("a18_distinct_values", "SELECT DISTINCT p_name, p_type FROM part")
def a18(spark, d):
    return table(spark, d, "part").select("p_name", "p_type").distinct()


@query("a20_reason_label", "SELECT o_orderpriority AS grp, string_agg(o_orderstatus || ' ' || n, ', ' ORDER BY n DESC, o_orderstatus) AS label FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def a20(spark, d):
    c = reports.detail_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return reports.histogram_label(c.withColumnRenamed("o_orderpriority", "grp"), "grp", "o_orderstatus")


@query("a21_usage_totals", "SELECT o_orderstatus, count(*) AS calls, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1")
def a21(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("cost"))


@query("o01_plugins_by_count", "SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY 1")
def o01(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_brand")))  # one row a plugin


@query("o02_rows_by_form", "SELECT p_brand, string_agg(lpad(upper(printf('%x', p_partkey)), 6, '0'), ',' ORDER BY p_partkey) AS forms FROM part WHERE p_size = 7 GROUP BY 1")
def o02(spark, d):
    p = table(spark, d, "part").where("p_size = 7").select("p_brand", F.lpad(F.hex("p_partkey"), 6, "0").alias("form"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("form")), ",").alias("forms"))


@query("o03_summary_views", "SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS by_name, row_number() OVER (ORDER BY n DESC, p_brand) AS by_count, row_number() OVER (ORDER BY ch DESC, p_brand) AS by_chars FROM (SELECT p_brand, count(*) AS n, sum(length(p_name)) AS ch FROM part GROUP BY 1)")
def o03(spark, d):
    n = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("p_name")).alias("ch"))
    place = lambda *o: F.row_number().over(Window.orderBy(*o))  # noqa: E731  one row a plugin
    return n.select("p_brand", place("p_brand").alias("by_name"), place(F.desc("n"), "p_brand").alias("by_count"), place(F.desc("ch"), "p_brand").alias("by_chars"))


@query("o05_blockers_of_two", "SELECT w AS word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size < 3) GROUP BY 1 HAVING count(*) >= 2")
def o05(spark, d):
    w = table(spark, d, "part").where("p_size < 3").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").orderBy(F.desc("n"), "word")


@query("o06_first_samples", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 3")
def o06(spark, d):
    return overlay.first_rows(table(spark, d, "part"), ["p_brand"], [F.asc("p_partkey")], 3).select("p_brand", "p_partkey")


@query("o07_by_untranslated_chars", "SELECT p_brand, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part WHERE p_size <= 25 GROUP BY 1")
def o07(spark, d):
    return table(spark, d, "part").where("p_size <= 25").groupBy("p_brand").agg(F.sum(F.char_length("p_name")).cast("long").alias("chars")).orderBy(F.desc("chars"), "p_brand")


@query("u01_corpus_union", "SELECT kind, count(*) AS n FROM (SELECT p_name AS english, 'vanilla' AS kind FROM part UNION ALL SELECT n_name, 'dsd' FROM nation UNION ALL SELECT r_name, 'reference' FROM region UNION ALL SELECT s_name, 'imported' FROM supplier) GROUP BY 1")
def u01(spark, d):
    parts = [table(spark, d, t).select(F.col(c).alias("english"), F.lit(k).alias("kind")) for t, c, k in (("part", "p_name", "vanilla"), ("nation", "n_name", "dsd"), ("region", "r_name", "reference"), ("supplier", "s_name", "imported"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("u02_set_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def u02(spark, d):
    c, s = table(spark, d, "customer").where("c_acctbal < 0"), table(spark, d, "supplier").where("s_acctbal < 0")
    return c.select(F.col("c_nationkey").alias("k")).union(s.select("s_nationkey")).distinct()


@query("u03_name_union", "SELECT DISTINCT lower(x) AS k FROM (SELECT n_name AS x FROM nation UNION ALL SELECT upper(r_name) FROM region UNION ALL SELECT lower(n_name) FROM nation)")
def u03(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.select(F.lower("n_name").alias("k")).union(r.select(F.lower("r_name"))).distinct()


@query("u04_missing_plugins", "SELECT lower(n_name) AS n_name FROM nation EXCEPT SELECT lower(n_name) FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000")
def u04(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier").where("s_acctbal > 9000")
    return reports.missing(n, n.join(s, n.n_nationkey == s.s_nationkey, "left_semi"), "n_name")


@query("u05_set_containment", "SELECT l_orderkey, list_has_all([1, 2, 3], list(DISTINCT CAST(l_linenumber AS INTEGER))) AS subset, list_has_any([5, 6], list(DISTINCT CAST(l_linenumber AS INTEGER))) AS meets FROM lineitem GROUP BY 1")
def u05(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber").cast("int")).alias("s"))
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    return g.select("l_orderkey", (F.size(F.array_except("s", a(1, 2, 3))) == 0).alias("subset"), F.arrays_overlap("s", a(5, 6)).alias("meets"))


@query("t19_interface_summary", "SELECT p_brand AS target, count(*) AS n_rows, count(*) FILTER (p_size <= 25) AS untranslated FROM part GROUP BY 1")
def t19(spark, d):
    return iface.summary(table(spark, d, "part").select(F.col("p_brand").alias("target"), (F.col("p_size") > 25).alias("resolved")))


@query("f30_output_rule", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'SJPTS_TranslationProposed' ELSE 'SJPTS_AutoCorpusOverride' END AS status, (p_partkey % 3 = 1 AND p_partkey % 4 = 0) AS notice FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def f30(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN 'bad' ELSE lpad(hex(p_partkey), 8, '0') || '|A.esp' END").alias("form_id"), F.expr("CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_name ELSE '剣' END").alias("japanese"), F.expr("CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'SJPTS_AutoCorpusOverride' END").alias("notes"))
    return cascade.output_rows(p).select("p_partkey", "status", "notice")
