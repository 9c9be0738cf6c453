"""Queries of readers and writers: a table is written as a set of files in the shared folder, and the files are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files, filesets, instance
from .registry import query, table
from .session import checkpoint_dir

TEXT = "p_name || chr(9) || chr(92) || p_brand || chr(10) || 'é剣'"


def published(lines: DataFrame, bom: bool = True) -> str:
    """Write lines (path, section, a, b, c, line) below a new root in the shared folder."""
    root = f"{checkpoint_dir(lines.sparkSession)}/files-{uuid.uuid4().hex}"
    filesets.write_file_set(lines, root, filesets.ORDER, bom)
    return root


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part").withColumn("t", F.expr("concat(p_name, '\\t', '\\\\', p_brand, '\\n', 'é剣')")).withColumn("form", F.concat(F.hex("p_partkey"), F.lit("|A.esp")))


def as_lines(df: DataFrame, path, line, order) -> DataFrame:
    """One line a row of ``df``, in the order of a number."""
    return df.select(path.alias("path"), F.lit(1).alias("section"), order.cast("long").alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), line.alias("line"))


@query("s02_corpus_rows", f"SELECT {TEXT} AS english, p_brand AS source, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS type FROM part")
def s02(spark, d):
    """Rows of four columns and of five in one file."""
    p = parts(spark, d)
    cells = lambda *c: F.concat_ws("\t", *[X.escape_tsv(F.col(x)) for x in ("t", "p_name", "p_brand", "p_type")], *c)
    line = F.when(F.col("p_size") % 2 == 0, cells(F.col("p_type"))).otherwise(cells())
    head = p.limit(1).select(F.lit("\t".join(files.CORPUS)).alias("line"))
    root = published(as_lines(p, F.lit("corpus.tsv"), line, F.col("p_partkey")).unionByName(as_lines(head, F.lit("corpus.tsv"), F.col("line"), F.lit(-1))))
    return files.corpus(spark, f"{root}/corpus.tsv").select(F.col("English").alias("english"), F.col("Source").alias("source"), F.coalesce("DsdType", F.lit("")).alias("type"))


@query("s03_coverage_rows", "SELECT p_brand AS plugin, count(*) AS total, count(*) FILTER (p_size % 2 = 0) AS translated, round(100.0 * count(*) FILTER (p_size % 2 = 0) / count(*), 1) AS ratio FROM part GROUP BY 1")
def s03(spark, d):
    per = table(spark, d, "part").groupBy(F.col("p_brand").alias("Plugin")).agg(F.count(F.lit(1)).alias("TotalCount"), F.count_if(F.col("p_size") % 2 == 0).alias("TranslatedCount"))
    ratio = F.format_string("%.1f", F.round(F.lit(100.0) * F.col("TranslatedCount") / F.col("TotalCount"), 1))
    per = per.withColumns({"UntranslatedCount": F.col("TotalCount") - F.col("TranslatedCount"), "Ratio": ratio, **{c: F.lit("0") for c in files.COVERAGE[5:]}})
    root = published(filesets.tsv(per, F.lit("coverage.tsv"), "\t".join(files.COVERAGE), files.COVERAGE, F.lit(0), F.col("Plugin")))
    return files.coverage(spark, f"{root}/coverage.tsv").select(F.col("Plugin").alias("plugin"), F.col("TotalCount").alias("total"), F.col("TranslatedCount").alias("translated"), F.col("Ratio").alias("ratio"))


@query("s04_header_rows", f"SELECT p_partkey, {TEXT} AS english, '' AS notes FROM part")
def s04(spark, d):
    p = parts(spark, d).select(F.lit("x").alias("Unknown"), F.col("t").alias("EnglishText"), F.col("p_partkey").alias("Key"), F.concat("p_brand", F.lit(".tsv")).alias("path"))
    root = published(filesets.tsv(p, F.col("path"), "Unknown\tEnglishText\tKey", ["Unknown", "EnglishText", "Key"], F.col("Key")))
    return files.by_header(spark, f"{root}/*.tsv", ["Key", "EnglishText", "Notes"]).select(F.col("Key").cast("long").alias("p_partkey"), F.col("EnglishText").alias("english"), F.col("Notes").alias("notes"))


@query("s05_k05_translation_files", f"SELECT p_brand AS plugin, p_partkey, {TEXT} AS english, CAST(p_size AS INTEGER) AS idx FROM part")
def s05(spark, d):
    """One translations.tsv a plugin in its own folder, found below the root (S06) and read by position."""
    p = parts(spark, d).select(F.col("form").alias("FormId"), F.col("p_brand").alias("WinningPlugin"), F.lit("WEAP FULL").alias("RecordType"), F.col("t").alias("EnglishText"), F.lit("剣").alias("Japanese"), F.lit("").alias("Notes"), F.col("p_size").alias("Index"), F.lit("").alias("EditorId"), F.lit("").alias("TranslationCheck"), "p_partkey")
    path = F.concat("WinningPlugin", F.lit("/translations.tsv"))
    root = published(filesets.tsv(p, path, "\t".join(files.TRANSLATIONS), files.TRANSLATIONS, F.col("p_partkey")))
    rows = files.translations(spark, files.find(spark, root))
    number = F.conv(F.substring_index("FormId", "|", 1), 16, 10).cast("long")
    return rows.select(F.col("WinningPlugin").alias("plugin"), number.alias("p_partkey"), F.col("EnglishText").alias("english"), F.col("Index").alias("idx"))


@query("s06_found_files", "SELECT p_brand AS plugin FROM part GROUP BY 1")
def s06(spark, d):
    p = table(spark, d, "part").select(F.concat("p_brand", F.lit("/translations.tsv")).alias("path")).distinct()
    root = published(as_lines(p, F.col("path"), F.lit("x"), F.lit(0)))
    found = spark.createDataFrame([(f,) for f in files.find(spark, root)], "f string")
    return found.select(F.url_decode(F.element_at(F.split("f", "/"), -2)).alias("plugin"))


@query("s12_mod_list", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS priority, s_name AS mod FROM supplier WHERE s_nationkey % 3 <> 0")
def s12(spark, d):
    sign = F.when(F.col("s_nationkey") % 3 == 0, "-").otherwise("+")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(sign, "s_name").alias("line"))
    extra = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "# note").otherwise("+A group_separator").alias("line"))
    root = published(as_lines(s.unionByName(extra), F.lit("modlist.txt"), F.col("line"), F.col("s_suppkey")))
    return files.mod_list(spark, f"{root}/modlist.txt").select("priority", "mod")


@query("s13_s24_load_order", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS pos, s_name || '.esp' AS plugin FROM supplier WHERE s_nationkey % 3 <> 0")
def s13(spark, d):
    """The active plugins of an instance in the order of its list: its settings name the profile, its folders hold the lists."""
    mark = F.when(F.col("s_nationkey") % 3 == 0, "").otherwise("*")
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(mark, "s_name", F.lit(".esp")).alias("line"), F.concat("s_name", F.lit(".esp")).alias("plugin"))
    lists = as_lines(s, F.lit("profiles/P 1/plugins.txt"), F.col("line"), F.col("s_suppkey")).unionByName(as_lines(s, F.lit("profiles/P 1/modlist.txt"), F.concat(F.lit("+"), "plugin"), F.col("s_suppkey")))
    settings = spark.createDataFrame([(0, "[General]"), (1, "selected_profile=@ByteArray(P 1)")], "k int, line string")
    root = published(lists.unionByName(as_lines(settings, F.lit("ModOrganizer.ini"), F.col("line"), F.col("k"))))
    out = instance.order(spark, instance.read(spark, root), s.select("plugin"), spark.createDataFrame([], "plugin string"))
    order = F.row_number().over(_by("pos")) - 1
    return out.select(order.cast("int").alias("pos"), "plugin")


def _by(column: str):
    from pyspark.sql.window import Window

    return Window.orderBy(column)  # a load order is a list of files


@query("s15_word_list", "SELECT DISTINCT p_name AS word FROM part")
def s15(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "# note").when(F.col("p_partkey") % 4 == 1, "  ").otherwise("").alias("line"))
    words = table(spark, d, "part").select("p_partkey", F.concat(F.lit("\t "), "p_name", F.lit("　")).alias("line"))
    root = published(as_lines(p.unionByName(words), F.lit("words.txt"), F.col("line"), F.col("p_partkey")))
    return files.word_list(spark, f"{root}/words.txt").distinct()


@query("s16_glossary", "SELECT arg_max(n, p_partkey) AS english, arg_max(p_brand, p_partkey) AS japanese FROM (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS n FROM part) GROUP BY lower(n)")
def s16(spark, d):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    root = published(as_lines(table(spark, d, "part"), F.lit("glossary.tsv"), F.concat_ws("\t", name, "p_brand", F.lit("more")), F.col("p_partkey")))
    return files.glossary(spark, f"{root}/glossary.tsv")


@query("s17_phrase_overrides", "SELECT p_name AS english, p_brand AS japanese FROM part WHERE p_size % 3 <> 0")
def s17(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("\t", "p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))).alias("line"))
    head = p.limit(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("English\tJapanese").alias("line"))
    root = published(as_lines(p.unionByName(head), F.lit("overrides.tsv"), F.col("line"), F.col("p_partkey")))
    return files.phrase_overrides(spark, f"{root}/overrides.tsv")


@query("s18_optional_corpus", f"SELECT {TEXT} AS english, p_brand AS source FROM part")
def s18(spark, d):
    """A reference glossary that is there, with one that is not."""
    p = parts(spark, d).select(F.col("t").alias("English"), F.lit("剣").alias("Japanese"), F.col("p_brand").alias("Source"), F.lit("reference").alias("SourceKind"), "p_partkey")
    root = published(filesets.tsv(p, F.lit("reference.tsv"), "\t".join(files.CORPUS), files.CORPUS[:4], F.col("p_partkey")))
    both = files.optional_corpus(spark, f"{root}/reference.tsv").unionByName(files.optional_corpus(spark, f"{root}/absent.tsv"))
    return both.select(F.col("English").alias("english"), F.col("Source").alias("source"))


@query("s20_staged_strings", "SELECT lower(p_name) AS path, CASE WHEN min(p_size % 3) = 0 THEN 'mod' ELSE 'game' END AS location FROM part GROUP BY 1")
def s20(spark, d):
    p = table(spark, d, "part")
    winners = p.where("p_size % 3 = 0").select(F.initcap("p_name").alias("path"), F.lit("mod").alias("location")).distinct()
    game = p.select(F.col("p_name").alias("path"), F.lit("game").alias("location")).distinct()
    return instance.staged(winners, game).select(F.lower("path").alias("path"), "location")


@query("k03_candidate_lines", """WITH per AS (SELECT p_brand AS plugin, count(*) AS n FROM part GROUP BY 1), l AS (
 SELECT n, plugin, 0 AS k, '## ' || plugin || ' (' || n || '件)' AS line FROM per UNION ALL SELECT n, plugin, 1 + p_partkey, '  ' || lpad(upper(printf('%x', p_partkey)), 6, '0') || chr(9) || '[' || p_type || ']' || chr(9) || p_name FROM part JOIN per ON plugin = p_brand
 UNION ALL SELECT n, plugin, 1000000000000, '' FROM per)
 SELECT 6 + row_number() OVER (ORDER BY n DESC, plugin, k) AS line_no, line FROM l
 UNION ALL SELECT 6 + (SELECT count(*) FROM l) + 1, '## 要レビュー（DSD翻訳は適用されているが、原文が変わった可能性あり）' UNION ALL SELECT 6 + (SELECT count(*) FROM l) + 2 + r_regionkey, '  ' || r_name FROM region""")
def k03(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("plugin"), F.lpad(F.hex("p_partkey"), 6, "0").alias("form_id"), F.col("p_type").alias("type"), F.col("p_name").alias("text"))
    review = table(spark, d, "region").select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("line"))
    root = published(filesets.candidate_list(p, review, "P", "2026-01-01 00:00:00"))
    return files.lines(spark, f"{root}/candidates.txt").where("line_no > 6").select("line_no", "line")


@query("k06_report_lines", """WITH per AS (SELECT p_brand AS plugin, count(*) AS t, count(*) FILTER (p_size % 2 = 0) AS r FROM part GROUP BY 1)
 SELECT 'translation_index.txt' AS file, 4 + row_number() OVER (ORDER BY t DESC, plugin) AS line_no, printf('%6d件（自動解決%5d件）', t, r) || chr(9) || plugin || chr(9) || 'out/' || plugin AS line FROM per
 UNION ALL SELECT 'translation_index.txt', 3, '# プラグイン数: ' || count(*) || ', 候補総数: ' || sum(t) || ', 自動解決: ' || sum(r) FROM per
 UNION ALL SELECT 'active_plugins.tsv', 2 + n_nationkey, n_nationkey || chr(9) || n_name || chr(9) || CASE WHEN n_nationkey % 2 = 0 THEN 'True' ELSE 'False' END FROM nation""")
def k06(spark, d):
    per = table(spark, d, "part").groupBy(F.col("p_brand").alias("plugin")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") % 2 == 0).alias("resolved")).withColumn("dir", F.concat(F.lit("out/"), "plugin"))
    n = table(spark, d, "nation")
    plugins = filesets.active_plugins(n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("plugin")), n.where("n_nationkey % 2 = 0").select(F.upper("n_name").alias("plugin")))
    root = published(filesets.translation_index(per, "2026-01-01 00:00:00").unionByName(plugins))
    out = files.lines(spark, root).select(F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", "line")
    return out.where("file = 'translation_index.txt' and line_no > 2 and line <> '' or file = 'active_plugins.tsv' and line_no > 1")


@query("k07_derived_lines", """SELECT 'derived_transliteration_dict.tsv' AS file, 1 + row_number() OVER (ORDER BY p_name) AS line_no, p_name || chr(9) || 'カナ' || chr(9) || 'official' || chr(9) AS line FROM (SELECT DISTINCT p_name FROM part)
 UNION ALL SELECT 'derived_meaning_dict.tsv', 1 + row_number() OVER (ORDER BY kind, lower(w), w), w || chr(9) || '意味' || chr(9) || kind || chr(9) || 'x' FROM (SELECT DISTINCT p_type AS w, 'head' AS kind FROM part UNION SELECT DISTINCT p_brand, 'modifier' FROM part)""")
def k07(spark, d):
    p = table(spark, d, "part")
    spelled = p.select(F.col("p_name").alias("english"), F.lit("カナ").alias("japanese"), F.lit("official").alias("origin"), F.lit(None).cast("string").alias("source")).distinct()
    meaning = lambda c, kind: p.select(F.col(c).alias("english"), F.lit("意味").alias("japanese"), F.lit(kind).alias("kind"), F.lit("x").alias("source")).distinct()
    root = published(filesets.derived_tables(spelled, meaning("p_type", "head").unionByName(meaning("p_brand", "modifier"))))
    return files.lines(spark, root).where("line_no > 1").select(F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", "line")


@query("k11_glossary_templates", """WITH b AS (SELECT p_brand, p_name, count(*) AS n, min(p_type) AS e FROM part GROUP BY ALL)
 SELECT p_brand AS plugin, 2 + row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS line_no, p_name || chr(9) || CASE WHEN n % 2 = 0 THEN '訳' ELSE '' END || chr(9) || n || chr(9) || e AS line FROM b""")
def k11(spark, d):
    b = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"), F.min("p_type").alias("e")).withColumn("ja", F.when(F.col("n") % 2 == 0, "訳"))
    root = published(filesets.glossary_template(b, ["Fill in."], ["p_name", "ja", "n", "e"], F.concat(F.lit("mods/"), "p_brand", F.lit(".tsv"))))
    out = files.lines(spark, f"{root}/mods").where("line_no > 2")
    return out.select(F.regexp_replace(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.tsv$", "").alias("plugin"), "line_no", "line")


@query("b04_checked_rows", """SELECT k % 5 AS kind, count(*) AS n, count(*) FILTER (k % 5 > 1) AS good, max(CASE k % 5 WHEN 0 THEN 'only 2 columns' WHEN 1 THEN 'Index is no number' END) AS error FROM (SELECT p_partkey AS k FROM part) GROUP BY 1
 UNION ALL SELECT -1, 1, 0, 'no such file'""")
def b04(spark, d):
    """Good rows and reasons in one scan; one file is not there."""
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.concat_ws("\t", k.cast("string"), F.lit("short"))).otherwise(F.concat_ws("\t", k.cast("string"), F.lit("A"), F.lit("T"), F.col("p_name"), F.when(k == 1, "seven").otherwise("7")))
    p = table(spark, d, "part")
    root = published(as_lines(p, F.lit("c.tsv"), line, F.col("p_partkey")).unionByName(as_lines(p.limit(1), F.lit("c.tsv"), F.lit("head"), F.lit(-1))))
    rows = files.checked(spark, [f"{root}/c.tsv", f"{root}/none.tsv"], ["Kind", "Plugin", "Type", "Text", "Index"], 4, ["Index"])
    kind = F.coalesce(F.coalesce("Kind", F.substring_index("raw", "\t", 1)).cast("long"), F.lit(-1))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("good"), F.max("error").alias("error"))
