"""Queries of the predicates and scalar functions, over texts derived from ``part`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs
from ..operators import inipatch
from .registry import query, table

#: One text a part that reaches every rule; plain SQL that both engines read alike.
SAMPLE = """CASE p_partkey % 18 WHEN 0 THEN p_name WHEN 1 THEN 'AudioTemplate' || p_name WHEN 2 THEN '  do not delete ' || p_name
 WHEN 3 THEN 'Patch 1.' || CAST(p_partkey AS STRING) WHEN 4 THEN p_name || ' fx' WHEN 5 THEN 'TEMP ' || p_name WHEN 6 THEN 'todo' WHEN 7 THEN 'NFL'
 WHEN 8 THEN '$KEY_' || CAST(p_partkey AS STRING) WHEN 9 THEN 'mesh' || CAST(p_partkey AS STRING) || '.nif' WHEN 10 THEN '<b>' || CAST(p_partkey AS STRING) || '</b>'
 WHEN 11 THEN '<i>' || p_name || '</i> 2' WHEN 12 THEN 'Iron Sword of the North' WHEN 13 THEN 'camelCase' || CAST(p_partkey AS STRING) WHEN 14 THEN 'ナイフ' || p_name
 WHEN 15 THEN '<mag>の剣' WHEN 16 THEN 'ナイフ' ELSE 'Steel ' || upper(substring(p_brand, 1, 1)) || 'attleaxe' END"""
DUCK = SAMPLE.replace("AS STRING", "AS VARCHAR")
JA = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]"
WS = "[\\s\\p{Z}]"
TRIM = f"regexp_replace(t, '^{WS}+|{WS}+$', '', 'g')"
NOTAG = "regexp_replace(t, '<[^>]*>', '', 'g')"
NAME = "list_bool_and([regexp_matches(w, '\\p{Lu}') OR lower(w) IN ('of','the','and','in','on','at','a','an') OR w = '-' OR regexp_matches(w, '^\\p{Nd}+$') OR regexp_matches(w, '(?i)^\\d+(st|nd|rd|th)$') FOR w IN string_split(t, ' ') IF w <> ''])"


def source(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_type", F.expr(SAMPLE).alias("t"))


def duck(body: str) -> str:
    return f"WITH s AS (SELECT p_partkey, p_type, {DUCK} AS t FROM part) {body}"


def flag(name: str, fn, sql: str) -> None:
    query(name, duck(f"SELECT p_partkey, t, ({sql}) AS hit FROM s"))(lambda spark, d, fn=fn: source(spark, d).select("p_partkey", "t", fn(F.col("t")).alias("hit")))


def value(name: str, fn, sql: str) -> None:
    query(name, duck(f"SELECT p_partkey, {sql} AS v FROM s"))(lambda spark, d, fn=fn: source(spark, d).select("p_partkey", fn(F.col("t")).alias("v")))


P = {
    "markup": f"({TRIM} = '' OR (contains(t, '<') AND (NOT regexp_matches({NOTAG}, '\\p{{L}}') OR (contains(lower(t), 'iconographia') AND length(trim({NOTAG})) <= 1))))",
    "asset": f"({TRIM} <> '' AND NOT regexp_matches({TRIM}, '{WS}') AND (regexp_matches({TRIM}, '(?i)\\.(nif|dds|wav|xwm|hkx|pex|swf|bik|tga)$') OR contains(t, '\\')))",
    "identifier": f"(length({TRIM}) >= 4 AND NOT regexp_matches({TRIM}, '{WS}') AND (regexp_matches(t, '\\p{{Ll}}\\p{{Lu}}') OR (regexp_matches(t, '\\p{{L}}') AND regexp_matches(t, '\\p{{Nd}}')) OR regexp_matches(t, '\\p{{Lu}}{{2,}}\\p{{Ll}}') OR (contains(t, '_') AND regexp_matches({TRIM}, '^[\\p{{Lu}}\\p{{Nd}}_]+$'))))",
    "audio": "regexp_matches(t, '(?i)^\\s*AudioTemplate')",
    "keep": "regexp_matches(t, '(?i)^\\s*Do Not Delete')",
    "version": "regexp_matches(t, '\\b\\d+\\.\\d+(\\.\\d+)?\\b')",
    "fx": "regexp_matches(t, '(?i) fx\\s*$')",
    "temp": "regexp_matches(t, '(?i)(^|[^A-Za-z])temp([^A-Za-z]|$)')",
    "placeholder": f"lower({TRIM}) IN ('xxx','todo','tbd','n/a','test','placeholder')",
    "acronym": f"(regexp_matches({TRIM}, '^\\p{{Lu}}{{3,}}$') AND NOT regexp_matches(t, '[AEIOU]'))",
    "key": f"regexp_matches({TRIM}, '^\\$[\\p{{L}}\\p{{Nd}}_]+$')",
}
IS_JA = f"regexp_matches(t, '{JA}')"
flag("f01_contains_japanese", X.contains_japanese, IS_JA)
flag("f02_translatable_english", X.is_translatable_english, f"NOT {IS_JA} AND regexp_matches(t, '\\p{{L}}')")
flag("f03_name_field", X.looks_like_name, NAME)
flag("f04_markup_only", X.is_markup_only, P["markup"])
flag("f05_internal_identifier", X.looks_like_identifier, P["identifier"])
flag("f06_audio_template", X.looks_like_audio_template, P["audio"])
flag("f07_do_not_delete", X.looks_like_do_not_delete, P["keep"])
flag("f08_version_note", X.looks_like_version_note, P["version"])
flag("f09_internal_fx", X.looks_like_internal_fx, P["fx"])
flag("f10_temp_placeholder", X.looks_like_temp, P["temp"])
flag("f11_placeholder_token", X.is_placeholder, P["placeholder"])
flag("f12_non_word_acronym", X.looks_like_acronym, P["acronym"])
flag("f13_interface_key", X.looks_like_interface_key, P["key"])
flag("f14_asset_path", X.is_asset_path, P["asset"])

CASCADE = " ".join(f"WHEN {P[k]} THEN '{n}'" for k, n in zip(P, [r[0] for r in X.TEXT_REASONS]))


@query("f15_exclusion_cascade", duck(f"SELECT coalesce(CASE {CASCADE} END, 'offered') AS reason, count(*) AS n FROM s GROUP BY 1"))
def f15(spark, d):
    reason = F.coalesce(X.exclusion_reason(F.col("t")), F.lit("offered"))
    return source(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


INI_CASE = f"""CASE WHEN {IS_JA} THEN 'AlreadyJapanese' WHEN NOT regexp_matches(t, '\\p{{L}}') THEN 'NoLetters' WHEN {P['markup']} THEN 'MarkupOnly'
 WHEN {P['key']} THEN 'InterfaceKeyReference' WHEN {P['asset']} THEN 'AssetPath' WHEN {P['placeholder']} THEN 'PlaceholderToken' WHEN {P['acronym']} THEN 'NonWordAcronym' END"""
value("f16_ini_exclusion", X.ini_exclusion_reason, INI_CASE)
ALNUM = "length(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
value(
    "f18_quality_class",
    X.quality_class,
    f"""CASE WHEN NOT {IS_JA} THEN 'NoJapanese' WHEN {ALNUM.format('t')} = 0 THEN 'AllJapanese' WHEN {ALNUM.format('t')} * 2 >= length(t) THEN 'ContainsMostOfAlphaNumeric'
 WHEN {ALNUM.format(NOTAG)} > 0 THEN 'ContainsPartsOfAlphaNumeric' ELSE 'ContainsTagAlphaNumeric' END""",
)
WORDS = "list_filter(string_split(t, ' '), lambda w: w <> '')"
SPLITTABLE = f"""(NOT (contains(lower(t), ' and ') OR contains(lower(t), ' or ') OR starts_with(t, 'No ') OR starts_with(t, 'Not ')) AND
 (len({WORDS}) BETWEEN 2 AND 3 OR (contains(t, ' of ') AND NOT contains(trim(split_part(t, ' of ', 1)), ' ') AND len(list_filter(string_split(regexp_replace(split_part(t, ' of ', 2), '(?i)^(the|an|a) ', ''), ' '), lambda w: w <> '')) BETWEEN 1 AND 2)))"""
flag("f20_mineable_english", X.is_mineable_english, f"""length(t) BETWEEN 1 AND 40 AND NOT regexp_matches(t, '[<>%\\[\\]()",.!?:;]') AND {NAME} AND regexp_matches(replace(t, ' ', ''), '^[A-Za-z''-]*$') AND {SPLITTABLE}""")
STOP = ",".join(f"'{w}'" for w in X.NAME_STOP_WORDS)
flag(
    "f21_proper_noun_phrase",
    X.looks_like_proper_noun,
    f"""NOT regexp_matches(t, '[!?.,;:]') AND len({WORDS}) BETWEEN 1 AND 3 AND
 list_bool_and([regexp_replace(w, '\\P{{L}}', '', 'g') <> '' AND lower(regexp_replace(w, '\\P{{L}}', '', 'g')) NOT IN ({STOP}) AND regexp_matches(regexp_replace(w, '\\P{{L}}', '', 'g'), '^\\p{{Lu}}') FOR w IN {WORDS}])""",
)
flag("f22_pure_katakana", X.is_pure_katakana, "regexp_matches(t, '^[\\x{30A0}-\\x{30FF}]+$')")
flag("f22_plain_phrase", X.is_plain_phrase, f"regexp_matches({TRIM}, '^[A-Za-z][A-Za-z'' -]*$')")


@query("f23_pass_through_tokens", duck(f"SELECT w, count(*) AS n FROM (SELECT unnest({WORDS}) AS w FROM s) WHERE regexp_matches(w, '^(-|\\p{{Nd}}+|\\p{{Lu}}|I{{1,3}}|IV|V|VI{{1,3}}|IX|X{{1,3}})$') GROUP BY w"))
def f23(spark, d):
    w = source(spark, d).select(F.explode(X.words(F.col("t"))).alias("w"))
    return w.where(X.is_pass_through(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("f26_tag_multiset_equality", "SELECT page_id, list_sort(regexp_extract_all(html, '<[^>]*>')) = list_sort(regexp_extract_all(replace(html, '</p><p>', '<p></p>'), '<[^>]*>')) AS same_tags FROM pages")
def f26(spark, d):
    other = F.replace(F.col("html"), F.lit("</p><p>"), F.lit("<p></p>"))
    return table(spark, d, "pages").select("page_id", X.same_tags(F.col("html"), other).alias("same_tags"))


F27_SQL = "regexp_extract_all(a, '<[^>]*>') = regexp_extract_all(b, '<[^>]*>') AND upper(trim(regexp_replace(a, '<[^>]*>', '', 'g'))) = upper(trim(regexp_replace(b, '<[^>]*>', '', 'g')))"


@query("f27_tag_aware_match", duck(f"SELECT p_partkey, ({F27_SQL}) AS hit FROM (SELECT p_partkey, t AS a, CASE p_partkey % 3 WHEN 0 THEN upper(t) WHEN 1 THEN ' ' || t ELSE replace(t, '<i>', '<em>') END AS b FROM s WHERE NOT {IS_JA})"))
def f27(spark, d):
    b = F.expr("CASE p_partkey % 3 WHEN 0 THEN upper(t) WHEN 1 THEN ' ' || t ELSE replace(t, '<i>', '<em>') END")
    s = source(spark, d).where(~X.contains_japanese(F.col("t"))).withColumn("b", b)
    return s.select("p_partkey", X.same_skeleton(F.col("t"), F.col("b")).alias("hit"))


@query("f28_text_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def f28(spark, d):
    p = table(spark, d, "part")
    hit = F.lit(False)
    for c in ("p_name", "p_brand", "p_type"):
        hit = hit | F.lower(c).contains("ring")
    return p.where(hit).select("p_partkey", "p_name")


RAW = "t || chr(9) || 'a\\b' || chr(10) || 'c' || chr(13)"


@query("x01_escape_tsv", duck(f"SELECT p_partkey, replace(replace(replace(replace({RAW}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '') AS v FROM s"))
def x01(spark, d):
    raw = F.concat("t", F.lit("\ta\\b\nc\r"))
    return source(spark, d).select("p_partkey", X.escape_tsv(raw).alias("v"))


@query("x02_unescape_tsv", duck("SELECT p_partkey, t || chr(9) || 'a\\n' || chr(10) || '\\q' AS v FROM s"))
def x02(spark, d):
    return source(spark, d).select("p_partkey", X.unescape_tsv(F.concat("t", F.lit("\\ta\\\\n\\n\\q"))).alias("v"))


value("x03_preview", lambda c: X.preview(F.concat(c, F.lit("\r\n and a good deal more text than fits"))), "CASE WHEN length(t || ' and a good deal more text than fits') + 1 > 40 THEN substr(t || ' ' || ' and a good deal more text than fits', 1, 40) || '…' ELSE t || ' ' || ' and a good deal more text than fits' END")
value("x04_safe_folder", X.safe_folder, "regexp_replace(t, '[<>:\"/\\\\|?*]', '_', 'g')")


@query("x05_form_id", "SELECT p_partkey, CAST(('0x' || right(h, 6)) AS INTEGER) AS local_id, p_brand AS mod FROM (SELECT p_partkey, p_brand, upper(lpad(printf('%x', p_partkey), 8, '0')) AS h FROM part)")
def x05(spark, d):
    form = F.concat(F.lpad(F.hex("p_partkey"), 8, "0"), F.lit("|"), F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.parse_form_id(form).alias("f")).select("p_partkey", "f.local_id", "f.mod")


SIGNS = {"widget": "MISC", "ring": "ARMO", "gear": "WEAP"}


@query("x06_signature_map", "SELECT p_partkey, CASE split_part(p_name, ' ', 2) WHEN 'widget' THEN 'MISC' WHEN 'ring' THEN 'ARMO' WHEN 'gear' THEN 'WEAP' ELSE upper(substr(split_part(p_name, ' ', 2), 1, 4)) END AS signature FROM part")
def x06(spark, d):
    kind = F.split_part("p_name", F.lit(" "), F.lit(2))
    known = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(known, kind), F.upper(F.substring(kind, 1, 4))).alias("signature"))


@query("x07_type_description", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promotional' WHEN p_type = 'STANDARD' THEN 'standard' ELSE lower(substr(p_type, 1, 4)) || '/' || p_size END AS description FROM part")
def x07(spark, d):
    whole = F.create_map(F.lit("PROMO"), F.lit("promotional"), F.lit("STANDARD"), F.lit("standard"))
    text = F.coalesce(F.try_element_at(whole, F.col("p_type")), F.concat_ws("/", F.lower(F.substring("p_type", 1, 4)), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", text.alias("description"))


@query("x08_field_extraction", "SELECT p_partkey, unnest(['FULL', 'DESC', 'RNAM']) AS field, unnest([p_name, p_type, p_brand]) AS value FROM part")
def x08(spark, d):
    fields = [F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("FULL", "p_name"), ("DESC", "p_type"), ("RNAM", "p_brand"))]
    return table(spark, d, "part").select("p_partkey", F.inline(F.array(*fields)))


@query("x09_context_bits", "SELECT p_partkey, list_aggregate(list_filter(range(0, 32), lambda b: (p_size >> CAST(b AS INTEGER)) & 1 = 1), 'string_agg', ',') AS slots FROM part WHERE p_size > 0")
def x09(spark, d):
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.expr("1") == F.call_function("shiftright", F.col("p_size"), b).bitwiseAND(F.lit(1)))
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", F.array_join(bits.cast("array<string>"), ",").alias("slots"))


#: The words of part names and how the spelling rules read them.
READ = {
    "anvil": "アンヴィル", "blue": "ブルエ", "bolt": "ボルト", "cold": "コルド", "gear": "ゲアル", "gizmo": "ギズモ", "hot": "ホト", "large": "ラルグ", "new": "ネウ", "old": "オルド", "plate": "プラト", "red": "レド", "ring": "リング",
    "rod": "ロド", "small": "スマッル", "widget": "ウィッジト",
}


@query("x10_transliterate", "WITH m AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{k}')" for w, k in READ.items()) + ") AS t(w, k)) SELECT p_partkey, p_name, a.k || '・' || b.k AS kana FROM part LEFT JOIN m a ON a.w = split_part(p_name, ' ', 1) LEFT JOIN m b ON b.w = split_part(p_name, ' ', 2)")
def x10(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", udfs.transliterate(F.col("p_name")).alias("kana"))


@query("x11_edit_similarity", "SELECT p_partkey, round(1.0 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS v FROM part")
def x11(spark, d):
    longest = F.greatest(F.char_length("p_name"), F.char_length("p_type"))
    return table(spark, d, "part").select("p_partkey", F.round(F.lit(1.0) - F.levenshtein("p_name", "p_type") / longest, 6).alias("v"))


STOP11 = ",".join(f"'{w}'" for w in X.RETRIEVAL_STOP_WORDS)
TOKENS = f"list_distinct(list_filter([lower(w) FOR w IN regexp_split_to_array(text, '[^A-Za-z'']+')], lambda w: length(w) > 2 AND w NOT IN ({STOP11})))"


@query("x12_retrieval_tokens", f"SELECT item_id, array_to_string(list_sort({TOKENS}), ' ') AS tokens FROM benchmark")
def x12(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(X.retrieval_tokens(F.col("text"))), " ").alias("tokens"))


@query("x16_ngrams", f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}''-]+'), lambda x: NOT regexp_matches(x, '^\\p{{Nd}}+$')) AS w FROM benchmark),
 g AS (SELECT item_id, unnest(range(1, 6)) AS n, w FROM w), r AS (SELECT item_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM g WHERE len(w) >= n)
 SELECT n, count(*) AS runs, count(DISTINCT array_to_string(w[i:i + n - 1], ' ')) AS kinds FROM r GROUP BY n""")
def x16(spark, d):
    g = table(spark, d, "benchmark").select(F.explode(X.ngrams(X.phrase_tokens(F.col("text")))).alias("g"))
    return g.groupBy(F.size(F.split("g", " ")).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("g").alias("kinds"))


@query("x18_head_modifier", "SELECT p_partkey, split_part(p_name, ' ', 2) AS head, split_part(p_name, ' ', 1) AS modifier FROM part")
def x18(spark, d):
    return table(spark, d, "part").select("p_partkey", X.split_head(F.col("p_name")).alias("s")).select("p_partkey", "s.head", "s.modifier")


value("x19_trailing_katakana", lambda c: X.trailing_katakana(F.concat(F.lit("鉄の"), c, F.lit("ソード"))), "regexp_extract('鉄の' || t || 'ソード', '[\\x{30A0}-\\x{30FF}]+$')")


@query("x20_tagged_answer", "SELECT p_partkey, trim(p_name, '\"') AS answer FROM part WHERE p_partkey % 2 = 0")
def x20(spark, d):
    from ..operators.batch import tagged_answer

    reply = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ok <SJPTS_TARGET>\""), F.col("p_name"), F.lit("\"</SJPTS_TARGET>"))).otherwise(F.lit("none"))
    return table(spark, d, "part").select("p_partkey", tagged_answer(reply).alias("answer")).where("answer is not null")


@query("x21_line_flattening", "SELECT doc_id, text AS restored, length(replace(text, chr(10), '<SJPTS_BR>')) AS flat_chars FROM documents WHERE NOT regexp_matches(text, '[ \\t\\r\\f\\v]\\n|\\n\\s')")
def x21(spark, d):
    flat = X.flatten_lines(F.col("text"))
    rows = table(spark, d, "documents").where(~F.col("text").rlike(r"[ \t\r\f\x0B]\n|\n\s"))
    return rows.select("doc_id", X.restore_lines(flat).alias("restored"), F.char_length(flat).cast("long").alias("flat_chars"))


@query("x22_normal_target", "SELECT s_suppkey, lower('Mod' || s_nationkey || '.esp') || '|' || CASE WHEN s_suppkey = 0 THEN '0' ELSE upper(printf('%x', s_suppkey)) END AS target FROM supplier UNION ALL SELECT s_suppkey, '@' || lower(s_name) FROM supplier")
def x22(spark, d):
    s = table(spark, d, "supplier")
    form = F.concat(F.lit("Mod"), F.col("s_nationkey"), F.lit(".esp|0x"), F.lpad(F.hex("s_suppkey"), 6, "0"))
    both = s.select("s_suppkey", F.explode(F.array(form, F.col("s_name"))).alias("raw"))
    return both.select("s_suppkey", X.normal_target(F.col("raw")).alias("target"))


@query("x24_ratios", "SELECT p_brand, round(100.0 * sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM part GROUP BY p_brand")
def x24(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(X.percent(F.count_if(F.col("p_size") > 25), F.count(F.lit(1))), 6).alias("pct"))


@query("x25_severity", duck("SELECT p_partkey, CASE WHEN v = 'NoJapanese' THEN 3 WHEN v = 'ContainsMostOfAlphaNumeric' THEN 2 WHEN v IN ('ContainsPartsOfAlphaNumeric') THEN 1 ELSE 0 END AS severity FROM (SELECT p_partkey, " + f"""CASE WHEN NOT {IS_JA} THEN 'NoJapanese' WHEN {ALNUM.format('t')} = 0 THEN 'AllJapanese' WHEN {ALNUM.format('t')} * 2 >= length(t) THEN 'ContainsMostOfAlphaNumeric'
 WHEN {ALNUM.format(NOTAG)} > 0 THEN 'ContainsPartsOfAlphaNumeric' ELSE 'ContainsTagAlphaNumeric' END""" + " AS v FROM s)"))
def x25(spark, d):
    q = X.quality_class(F.col("t"))
    level = F.when(q == "NoJapanese", 3).when(q == "ContainsMostOfAlphaNumeric", 2).when(q == "ContainsPartsOfAlphaNumeric", 1).otherwise(0)
    return source(spark, d).select("p_partkey", level.alias("severity"))


@query("x26_output_path", "SELECT s_suppkey, 'npc/zzz_SJPTS/' || s_name || '.ini' AS path FROM supplier")
def x26(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.insert_folder(F.concat(F.lit("npc/"), "s_name", F.lit(".ini"))).alias("path"))


@query("x27_target_count", "SELECT s_suppkey, 2 AS targets FROM supplier")
def x27(spark, d):
    seg = F.concat(F.lit("filterByNpcs="), "s_name", F.lit(" , ,x|"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", F.size(inipatch.segment_values(seg)).alias("targets"))
