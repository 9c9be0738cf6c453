"""Queries of the overlay and window operators. A record is an order; its contributors are its line items,
in the order of line number with a total tie-break; return flag R stands for "translated"."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import inipatch, overlay, reports, retrieval
from .registry import query, table

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
SQL_ORDER = ", ".join(ORDER)
DESC = ", ".join(f"{c} DESC" for c in ORDER)
TEXT = "l_returnflag || l_linestatus || CAST(l_partkey AS {})"


def line(spark, d):
    return table(spark, d, "lineitem").withColumn("t", F.expr(TEXT.format("STRING")))


LINES = f"SELECT *, {TEXT.format('VARCHAR')} AS t FROM lineitem"


@query("w01_chain_build", f"SELECT l_orderkey, string_agg(t, '>' ORDER BY {SQL_ORDER}) AS chain, count(*) AS links FROM ({LINES}) GROUP BY l_orderkey")
def w01(spark, d):
    c = overlay.chains(line(spark, d), ["l_orderkey"], ORDER, ["t"], "t")
    return c.select("l_orderkey", F.array_join("chain.t", ">").alias("chain"), F.size("chain").cast("long").alias("links"))


@query("w02_winner", f"SELECT l_orderkey, t, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {DESC}) AS n FROM ({LINES})) WHERE n = 1")
def w02(spark, d):
    return overlay.winners(line(spark, d), ["l_orderkey"], ORDER, ["t", "l_linenumber"])


JA = "l_returnflag = 'R'"


@query(
    "j04_cross_mod_precedent",
    f"""WITH a AS (SELECT l_orderkey, l_returnflag, l_linestatus AS t, 'v' || l_partkey AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) AS p FROM lineitem),
 j AS (SELECT a.*, (l_returnflag = 'R') AS ja, last_value(CASE WHEN l_returnflag <> 'R' THEN t END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref,
   max(p) OVER (PARTITION BY l_orderkey) AS top FROM a),
 k AS (SELECT l_orderkey, max(p) AS jp FROM j WHERE ja AND p < top GROUP BY l_orderkey),
 w AS (SELECT * FROM j WHERE p = top AND NOT ja)
 SELECT w.l_orderkey, w.t AS text, CASE WHEN x.p IS NOT NULL AND (x.ref IS NULL OR x.ref = w.t) THEN x.v END AS japanese, (x.p IS NOT NULL AND x.ref IS NULL) AS needs_review,
   CASE WHEN x.p IS NOT NULL AND x.ref <> w.t THEN x.v END AS skipped
 FROM w LEFT JOIN k USING (l_orderkey) LEFT JOIN j x ON x.l_orderkey = w.l_orderkey AND x.p = k.jp""",
)
def j04(spark, d):
    rows = table(spark, d, "lineitem").withColumn("text", F.expr("CASE WHEN l_returnflag = 'R' THEN 'v' || l_partkey ELSE l_linestatus END"))
    p = overlay.precedent(rows, ["l_orderkey"], ORDER, "text", F.expr(JA))
    return p.select("l_orderkey", "text", "japanese", "needs_review", F.col("skipped_japanese").alias("skipped"))


@query("w03_vfs_merge", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w03(spark, d):
    files = table(spark, d, "orders").withColumn("path", F.col("o_custkey").cast("string"))
    return overlay.merge_files(files, "path", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w04_first_entry_wins", "SELECT o_custkey, o_orderkey, c_mktsegment FROM (SELECT o_custkey, o_orderkey, c_mktsegment, row_number() OVER (PARTITION BY o_custkey ORDER BY c_nationkey DESC, o_orderpriority DESC, o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) WHERE n = 1")
def w04(spark, d):
    e = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_custkey").alias("folder"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("entry_no"))
    f = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("folder"), F.col("c_nationkey").alias("load_order"), "c_mktsegment")
    return overlay.first_entries(e, f.select("folder", "load_order"), ["o_custkey"]).join(f.select("folder", "c_mktsegment"), "folder").select("o_custkey", "o_orderkey", "c_mktsegment")


@query("w05_last_wins_flag", "SELECT o_custkey, o_orderstatus = 'F' AS flag FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w05(spark, d):
    w = overlay.winners(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    return w.select("o_custkey", (F.col("o_orderstatus") == "F").alias("flag"))


@query("w06_occurrence_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS occurrence FROM orders")
def w06(spark, d):
    return overlay.occurrences(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "occurrence")


@query(
    "w07_comment_binding",
    f"""WITH a AS (SELECT l_orderkey, l_returnflag = 'N' AS note, l_linestatus AS kind, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) AS n FROM lineitem),
 b AS (SELECT *, coalesce(sum(CASE WHEN note THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM a),
 c AS (SELECT l_orderkey, blk, kind, max_by('o' || l_partkey, n) AS o FROM b WHERE note GROUP BY ALL),
 e AS (SELECT l_orderkey, blk, string_agg(kind || '=' || o, ',' ORDER BY kind) AS notes FROM c GROUP BY ALL)
 SELECT b.l_orderkey, b.n AS line_no, coalesce(e.notes, '') AS notes FROM b LEFT JOIN e USING (l_orderkey, blk) WHERE NOT note""",
)
def w07(spark, d):
    from pyspark.sql.window import Window

    rows = table(spark, d, "lineitem").withColumn("line_no", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)))
    text = F.expr("CASE WHEN l_returnflag = 'N' THEN '; SJPTS ' || l_linestatus || ' | tag | o' || l_partkey ELSE 'data' END")
    out = overlay.bind_comments(rows.select("l_orderkey", "line_no", text.alias("line")), "l_orderkey", "line_no", "line")
    notes = F.array_join(F.transform(F.coalesce("comments", F.array().cast("array<struct<kind:string,notes:string,original:string>>")), lambda c: F.concat(c["kind"], F.lit("="), c["original"])), ",")
    return out.select("l_orderkey", "line_no", notes.alias("notes"))


@query("w08_hint_priority", "SELECT p_name AS english, p_brand AS japanese FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size % 8, p_partkey) AS n FROM part) WHERE n = 1")
def w08(spark, d):
    from ..operators.corpus import best_hints

    h = table(spark, d, "part").select(F.col("p_name").alias("english"), F.col("p_brand").alias("japanese"), (F.col("p_size") % 8).alias("priority"), F.col("p_partkey").alias("file_rank"))
    return best_hints(h).select("english", "japanese")


@query("w09_relative_cutoff", "SELECT query, id, rank FROM (SELECT p_brand AS query, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, 9) DESC, p_size, p_partkey) AS rank, p_retailprice >= 0.4 * max(p_retailprice) OVER (PARTITION BY p_brand) AS ok FROM part) WHERE ok AND rank <= 15")
def w09(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("query"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), "p_size")
    return retrieval.cut(s, 15, tie=("p_size", "id")).select("query", "id", "rank")


@query("w10_budgeted_prefix", "SELECT p_brand, p_partkey, used FROM (SELECT p_brand, p_partkey, sum(length(p_name)) OVER w AS used, row_number() OVER w AS rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING)) WHERE used <= 120 AND rank <= 10")
def w10(spark, d):
    b = retrieval.budget(table(spark, d, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], F.char_length("p_name"), 120, 10)
    return b.select("p_brand", "p_partkey", "used")


@query("w12_pool_maximum", "SELECT l_partkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1")
def w12(spark, d):
    return retrieval.hint_pool(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_extendedprice").alias("score")))


@query("w14_positional_index", f"SELECT l_orderkey, l_linenumber * 1000 + n - 1 AS idx, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {SQL_ORDER}) AS n FROM lineitem)")
def w14(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("x"))
    flat = nested.select("l_orderkey", "l_linenumber", F.posexplode("x").alias("pos", "s"))
    return flat.select("l_orderkey", (F.col("l_linenumber") * 1000 + F.col("pos")).cast("long").alias("idx"), "s.l_partkey")


@query("w15_first_warning", "SELECT o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w15(spark, d):
    return overlay.first_by(table(spark, d, "orders"), ["o_orderstatus"], [F.asc("o_orderkey")]).select("o_orderstatus", "o_orderkey")


@query(
    "f17_not_player_facing",
    """WITH e AS (SELECT l_partkey AS key, max_by(l_returnflag = 'R', struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_shipdate, e := l_extendedprice, f := l_quantity)) AS off FROM lineitem GROUP BY 1)
 SELECT key FROM e WHERE off UNION SELECT key FROM (SELECT l_suppkey + 3000000 AS key, max_by(l_linestatus = 'O', struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_shipdate, e := l_extendedprice, f := l_quantity)) AS off FROM lineitem GROUP BY 1) WHERE off UNION SELECT o_custkey + 1000000 FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F' OR NOT o_orderpriority <> '1-URGENT')
 UNION SELECT ps.s + 2000000 FROM (SELECT p_size AS s, p_partkey FROM part) ps LEFT JOIN e ON e.key = ps.p_partkey GROUP BY ps.s HAVING bool_and(coalesce(e.off, false))""",
)
def f17(spark, d):
    li, part, orders = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    effects = li.select(F.col("l_partkey").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity").alias("load_order"), (F.col("l_returnflag") == "R").alias("hidden"))
    items = li.select((F.col("l_suppkey") + 3000000).alias("key"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").alias("load_order"), (F.col("l_linestatus") == "O").alias("not_playable"))
    perks = orders.select((F.col("o_custkey") + 1000000).alias("key"), (F.col("o_orderstatus") == "F").alias("hidden"), (F.col("o_orderpriority") != "1-URGENT").alias("playable"))
    spells = part.select((F.col("p_size") + 2000000).cast("long").alias("key"), F.col("p_partkey").alias("effect"))
    return reports.not_player_facing(effects, items, perks, spells)


SUPPLIER_LINE = "'filterByNpcs=' || CASE s_suppkey % 3 WHEN 0 THEN 'Mod' || s_nationkey || '.esp|0x' || s_suppkey ELSE s_name END || ':fullName=~' || s_name || ': the ' || s_suppkey || '~'"


@query("s22_ini_line_parser", "SELECT s_suppkey, 'filterByNpcs=' || CASE s_suppkey % 3 WHEN 0 THEN 'Mod' || s_nationkey || '.esp|0x' || s_suppkey ELSE s_name END AS filter_part, 'FullName' AS kind, s_name || ': the ' || s_suppkey AS text FROM supplier")
def s22(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", inipatch.parse_lines(F.expr(SUPPLIER_LINE)).alias("p"))
    return s.select("s_suppkey", F.array_join("p.filters", ":").alias("filter_part"), F.explode("p.ops").alias("op")).select("s_suppkey", "filter_part", "op.kind", "op.text")


def ini_rows(spark, d):
    """One file a nation; every third supplier repeats an earlier target so that overrides occur."""
    target = "'Mod' || (s_nationkey % 5) || '.esp|0x' || (s_suppkey % 7)"
    gate = "CASE WHEN s_suppkey % 4 = 0 THEN 'hasPlugins=Mod1.esp,Mod' || (s_suppkey % 6) || '.esp:' ELSE '' END"
    text = f"{gate} || 'filterByNpcs=' || {target} || CASE WHEN s_suppkey % 3 = 0 THEN ',Mod1.esp|9' ELSE '' END || ':fullName=~' || s_name || '~'"
    path = "CASE WHEN s_nationkey % 6 = 4 THEN 'weapon/' ELSE 'npc/' END || CASE WHEN s_nationkey % 6 = 5 THEN 'Mod' || s_nationkey || '.esp' ELSE 'n' || s_nationkey END || '.ini'"
    return table(spark, d, "supplier").select(F.expr(path).alias("path"), F.col("s_suppkey").alias("line_no"), F.expr(text).alias("line"))


ACTIVE = ["mod0.esp", "mod1.esp", "mod2.esp", "mod3.esp"]
DISABLED = ["iEnableWeaponPatching"]
INI_SQL = """WITH r AS (SELECT CASE WHEN s_nationkey % 6 = 4 THEN 'weapon/' ELSE 'npc/' END || CASE WHEN s_nationkey % 6 = 5 THEN 'Mod' || s_nationkey || '.esp' ELSE 'n' || s_nationkey END || '.ini' AS path, s_suppkey AS n, s_name AS text, s_nationkey,
   s_suppkey % 4 = 0 AS gated, s_suppkey % 6 AS gm, list_distinct(list_concat(['mod' || (s_nationkey % 5) || '.esp|' || (s_suppkey % 7)], CASE WHEN s_suppkey % 3 = 0 THEN ['mod1.esp|9'] ELSE [] END)) AS t,
   CASE WHEN s_suppkey % 4 = 0 THEN 'hasplugins=mod1.esp,mod' || (s_suppkey % 6) || '.esp' ELSE '' END AS sig FROM supplier),
 g AS (SELECT *, CASE WHEN s_nationkey % 6 = 4 THEN 'TypeDisabled' WHEN s_nationkey % 6 = 5 AND s_nationkey NOT IN (0, 1, 2, 3) THEN 'FileGate' WHEN gated AND gm NOT IN (0, 1, 2, 3) THEN 'LineGate'
   WHEN s_nationkey % 5 = 4 AND s_OTHER THEN 'TargetPluginMissing' ELSE '' END AS gate FROM (SELECT *, NOT list_contains(t, 'mod1.esp|9') AS s_OTHER FROM r))
 """


@query("f25_j17_gates_and_overrides", INI_SQL + """SELECT path, n AS line_no, text, CASE WHEN gate = '' AND EXISTS (SELECT 1 FROM g l WHERE l.path = g.path AND l.sig = g.sig AND l.gate = '' AND l.n > g.n AND list_has_all(l.t, g.t)) THEN 'OverriddenInSameFile' ELSE gate END AS inactive FROM g""")
def f25(spark, d):
    e = inipatch.evaluate(ini_rows(spark, d), F.lit(ACTIVE), F.lit(DISABLED))
    return e.select("path", "line_no", "text", "inactive")


@query("a15_self_audit", INI_SQL + """SELECT count(*) AS n_rows, count(*) FILTER (x <> '') AS inactive, CAST(0 AS BIGINT) AS excluded, count(*) FILTER (x = '') AS offered FROM
 (SELECT CASE WHEN gate = '' AND EXISTS (SELECT 1 FROM g l WHERE l.path = g.path AND l.sig = g.sig AND l.gate = '' AND l.n > g.n AND list_has_all(l.t, g.t)) THEN 'o' ELSE gate END AS x FROM g)""")
def a15(spark, d):
    e = inipatch.evaluate(ini_rows(spark, d), F.lit(ACTIVE), F.lit(DISABLED))
    return inipatch.audit(e, X.ini_exclusion_reason(F.col("text")))


@query("j08_ini_carry_forward", "SELECT s_suppkey AS line_no, CASE WHEN s_suppkey % 2 = 0 THEN 'ja' || s_suppkey END AS covered, CASE WHEN s_suppkey % 2 = 1 THEN 'old ' || s_name END AS stale_original FROM supplier")
def j08(spark, d):
    s = table(spark, d, "supplier").select(F.lit("npc/x.ini").alias("path"), F.col("s_suppkey").alias("line_no"), F.concat(F.lit("k"), "s_suppkey").alias("filter_part"), F.lit(1).alias("occurrence"), F.lit("FullName").alias("kind"), F.col("s_name").alias("text"))
    prev = s.select("path", "filter_part", "occurrence", "kind", F.expr("CASE WHEN line_no % 2 = 0 THEN text ELSE 'old ' || text END").alias("original"), F.concat(F.lit("ja"), "line_no").alias("japanese"))
    return inipatch.carry_forward(s, prev).select("line_no", "covered", "stale_original")


@query("k08_ini_writer", "SELECT 'npc/zzz_SJPTS/n' || s_nationkey || '.ini' AS path, string_agg('; SJPTS FullName | auto | ' || s_name || chr(10) || 'filterByNpcs=x|' || s_suppkey || ':fullName=~ja' || s_suppkey || '~', chr(10) ORDER BY s_suppkey) AS text FROM supplier GROUP BY s_nationkey")
def k08(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("npc/n"), "s_nationkey", F.lit(".ini")).alias("path"), F.col("s_suppkey").alias("line_no"), F.concat(F.lit("filterByNpcs=x|"), "s_suppkey").alias("filter_part"), F.lit(1).alias("occurrence"), F.lit("FullName").alias("kind"), F.col("s_name").alias("text"), F.concat(F.lit("ja"), "s_suppkey").alias("japanese"), F.lit("auto").alias("notes"))
    return inipatch.render(s)
