"""The opN queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, html, langid, merkle, mixing, packing, parsing, sharding, simhash, topk, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = chat.format_conversations(rows.unionByName(extra))
    turns, learned = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda s: F.sha2(s.cast("binary"), 256)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(lines).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text: what the contracts hold rows out by."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, id_crc() % 4 != 2)
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_chain(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), id_crc() % 5 != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    vocabulary = bpe.Vocabulary(path("word_bpe_49k.json"))
    out = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha256(c):
    return F.sha2(c.cast("binary"), 256)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"), sha256(restored).alias("restored_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), tampered=id_crc() % 3 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", sha256(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    coder = packing.Coder(path("byte_bpe_50k.json"))
    out = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), coder))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_OPERATORS = op1_simhash, op2_chat, op3_sharding, op4_mixing, op5_html, op6_langid, op7_topk, op8_fingerprints, op9_toxicity, op10_bpe, op11_fim, op12_merkle, op13_packing
QUERIES = {f.__name__: f for f in _OPERATORS}

_FIM_SQL = """
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units
  from documents),
drawn as (
  select *, len(units) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
  from hashed),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
parts as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:n], '') as suffix from cut)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def _merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """A tree by levels and every proof by folding: groups of up to 8^levels leaves, up to 8^upper groups."""
    field = lambda c: f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"""
with crcs as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
marked as (
  select *, xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ord(d) as bigint)),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1]), 4294967295), 4294967295) % 3 = 0 as hit
  from documents, crcs),
leaves as (
  select doc_id, lang, {leaf("text")} as leaf, case when hit then {leaf(low)} else {leaf("text")} end as given from marked),
l0 as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from leaves),
t0 as (select lang, place, leaf as h from l0)"""]

    def climb(name: str, at: int, key: str) -> None:
        out.append(f"""{name}{at + 1} as (
  select {key}, p as place, case when many then sha256(string_agg(h, '' order by place)) else any_value(h) end as h
  from (select *, case when many then place // 8 else place end as p from (select *, count(*) over (partition by {key}) > 1 as many from {name}{at})) group by {key}, p, many)""")

    for k in range(levels):
        climb("t", k, "lang")
    out.append(f"u0 as (select 0 as tree, lang, row_number() over (order by lang nulls first) - 1 as place, h from t{levels})")
    for k in range(upper):
        climb("u", k, "tree")
    out.append("f0 as (select doc_id, lang, leaf, given, place as at, given as h, '' as proof from l0)")

    def fold(source: str, name: str, k: int, tree: str, on: str) -> None:
        out.append(f"""{name} as (
  select f.doc_id, f.lang, f.leaf, f.given, case when s.many then f.at // 8 else f.at end as at,
    case when s.many then sha256(coalesce(string_agg(case when x.place < f.at then x.h end, '' order by x.place), '') || f.h || coalesce(string_agg(case when x.place > f.at then x.h end, '' order by x.place), '')) else f.h end as h,
    f.proof || case when s.many then coalesce(string_agg(case when x.place <> f.at then x.h end, '' order by x.place), '') else '' end as proof
  from {source} f join (select {on} as g, count(*) > 1 as many from {tree}{k} group by 1) s on s.g is not distinct from {"f.lang" if on == "lang" else "0"}
  join {tree}{k} x on {"x.lang is not distinct from f.lang" if on == "lang" else "true"} and x.place // 8 = f.at // 8
  group by f.doc_id, f.lang, f.leaf, f.given, f.at, f.h, f.proof, s.many)""")

    for k in range(levels):
        fold(f"f{k}", f"f{k + 1}", k, "t", "lang")
    out.append(f"g0 as (select f.doc_id, f.lang, f.leaf, f.given, u.place as at, f.h, f.proof from f{levels} f join u0 u on u.lang is not distinct from f.lang)")
    for k in range(upper):
        fold(f"g{k}", f"g{k + 1}", k, "u", "tree")
    out.append(f"""roots as (select h as root from u{upper}), tops as (select lang, h as subroot from t{levels})
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, g.h as folded_root, g.h = root as verified
from g{upper} g join tops on tops.lang is not distinct from g.lang, roots""")
    head, tail = out[:-1], out[-1]
    return ",\n".join(head) + ",\n" + tail


ORACLE_SQL: dict[str, str] = {"op11_fim": _FIM_SQL, "op12_merkle": _merkle_sql()}
