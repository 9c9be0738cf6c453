"""Queries of the file formats: every one renders a table as a file's text, reads it back, or both."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import iface, reports
from ..sources import sinks
from .registry import query, table


@query("s01_k01_tsv_round_trip", "SELECT p_partkey, p_name || chr(9) || 'a\\b' || chr(10) || 'c' AS v FROM part")
def s01(spark, d):
    p = table(spark, d, "part").withColumn("v", F.concat("p_name", F.lit("\ta\\b\nc\r")))
    lines = p.select(sinks.tsv_line(["p_partkey", "v"]).alias("l"))
    return lines.select(F.split("l", "\t").alias("c")).select(F.get("c", F.lit(0)).cast("long").alias("p_partkey"), X.unescape_tsv(F.get("c", F.lit(1))).alias("v"))


@query("k02_distinct_corpus", "SELECT DISTINCT p_name, p_type FROM part")
def k02(spark, d):
    return table(spark, d, "part").select("p_name", "p_type").dropDuplicates()


@query("k03_candidate_list", "SELECT p_brand AS plugin, count(*) AS n, string_agg(lpad(upper(printf('%x', p_partkey)), 6, '0') || chr(9) || p_name, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def k03(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("plugin"), F.lpad(F.hex("p_partkey"), 6, "0").alias("form_id"), F.col("p_name").alias("text"))
    return sinks.candidate_list(p)


@query("k04_s08_json_round_trip", "SELECT p_brand AS plugin, p_name AS original, CAST(p_size AS INTEGER) AS index FROM part")
def k04(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.col("p_brand").alias("plugin"), F.col("p_partkey").alias("row_id"), F.lit("e").alias("editor_id"), F.concat(F.hex("p_partkey"), F.lit("|A.esp")).alias("form_id"), F.col("p_size").cast("int").alias("index"), F.lit("WEAP FULL").alias("type"), F.col("p_name").alias("original"), F.lit("剣").alias("string"), F.lit("x").alias("status"))
    back = F.from_json("json", "array<struct<editor_id: string, form_id: string, index: int, type: string, original: string, string: string, status: string>>")
    return sinks.json_files(e).select("plugin", F.explode(back).alias("e")).select("plugin", "e.original", "e.index")


@query("s07_folder_guard", "SELECT p_brand, count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS kept FROM part GROUP BY 1")
def s07(spark, d):
    p = table(spark, d, "part").withColumn("path", F.expr("'/out/' || CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE 'other' END || '/translations.tsv'"))
    return reports.folder_guard(p, "p_brand", "path").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_folder").alias("kept"))


@query("s08_json_properties", "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid FROM events GROUP BY 1")
def s08(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.try_parse_json("props")).alias("valid"))


@query("s09_xml_rows", "SELECT p_partkey, p_type || ' FULL' AS type, p_name AS english FROM part")
def s09(spark, d):
    xml = F.format_string("<String><REC>%s:FULL</REC><Source>%s</Source><Dest>x</Dest></String>", "p_type", "p_name")
    row = F.from_xml(xml, "REC string, Source string, Dest string")
    out = table(spark, d, "part").select("p_partkey", row.alias("r"))
    return out.select("p_partkey", F.replace("r.REC", F.lit(":"), F.lit(" ")).alias("type"), F.col("r.Source").alias("english"))


@query("s10_interface_last_wins", "SELECT o_custkey AS file, o_orderstatus AS key, arg_max(o_orderpriority, o_orderkey) AS value, min(o_orderkey) AS line_no FROM orders GROUP BY ALL")
def s10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("line_no"))
    return iface.last_wins(o)


@query("s11_s21_ini_sections", "SELECT l_orderkey AS file, CASE WHEN s IS NULL THEN 'General' ELSE s END AS section, 'k' || l_suppkey AS key, max_by(CAST(l_partkey AS VARCHAR), n) AS value FROM (SELECT *, last_value(CASE WHEN l_returnflag = 'A' THEN 's' || l_linestatus END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n) AS s FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS n FROM lineitem)) WHERE l_returnflag = 'R' GROUP BY ALL")
def s11(spark, d):
    from pyspark.sql.window import Window

    from .q_overlay import ORDER

    rows = table(spark, d, "lineitem").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))
    text = F.expr("CASE l_returnflag WHEN 'A' THEN '[s' || l_linestatus || ']' WHEN 'R' THEN ' k' || l_suppkey || ' = ' || l_partkey ELSE '; comment' END")
    return iface.sections(rows.select(F.col("l_orderkey").alias("file"), "line_no", text.alias("line")))


@query("s14_mixed_encoding", "SELECT s_suppkey, 'caf' || chr(233) || ' ' || chr(8364) || ' ' || s_name AS text FROM supplier")
def s14(spark, d):
    from ..sources.files import mixed_text

    utf8 = F.encode(F.concat(F.lit("café € "), F.col("s_name")), "UTF-8")
    western = F.encode(F.concat(F.lit("café \u0080 "), F.col("s_name")), "ISO-8859-1")
    return table(spark, d, "supplier").select("s_suppkey", mixed_text(F.when(F.col("s_suppkey") % 2 == 0, utf8).otherwise(western)).alias("text"))


@query("s25_plugin_paths", "SELECT lower(p_name) AS name, arg_min(p_brand || '/' || p_partkey, struct_pack(t := p_size % 3, p := p_partkey)) AS path FROM part GROUP BY 1")
def s25(spark, d):
    from ..sources.files import plugin_paths

    p = table(spark, d, "part").select(F.upper("p_name").alias("name"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") % 3).alias("tier"), F.col("p_partkey").alias("priority"))
    return plugin_paths(p)


@query("k09_interface_lines", "SELECT p_partkey AS line_no, '$K' || p_partkey || chr(9) || CASE WHEN p_partkey % 2 = 0 THEN 'ja' ELSE p_name END AS line FROM part")
def k09(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("$K"), "p_partkey").alias("key"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'ja' ELSE '' END").alias("japanese"), F.col("p_name").alias("english"))
    return sinks.interface_lines(p)


@query("k12_prompt_package", "SELECT p_name AS text, count(*) AS n, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS hints FROM part GROUP BY 1")
def k12(spark, d):
    return sinks.prompt_package(table(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_type").alias("hint")))


@query("k13_excluded_list", "SELECT *, count(*) OVER (PARTITION BY category) AS kinds FROM (SELECT p_type AS category, p_name AS item, count(*) AS n FROM part GROUP BY ALL)")
def k13(spark, d):
    return sinks.grouped_list(table(spark, d, "part").select(F.col("p_type").alias("category"), F.col("p_name").alias("item")), "category", "item")
