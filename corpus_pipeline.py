"""The training-data pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet and reads it again as the next one's documents. All but the last return the columns of
documents, whatever those are besides doc_id, text, lang and source. Names used inside avoid those of the columns.

Defined results: a null, empty or letterless text has no language and is rejected by the first stage, so later stages see none in
``run``; called on their own they keep such rows, but mixing takes nothing of a text without a word. Null ids, langs and sources are
values like any other. Rows that agree in every column are one document to near-duplicate search and share their copies in mixing.
Ties go to the least id, then the least hash of the row. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import bpe, langid, mixing, simhash, toxicity
from glossweave.llm.common import checkpoint, checkpoint_dir, partitions, remove, table, unused
from glossweave.llm.queries import id_crc

#: A document whose language is predicted with less than this probability is rejected.
MIN_LANGUAGE_SCORE = 0.5
#: A document at or above this toxicity is rejected.
MAX_TOXICITY = 0.5


def row_key(docs: DataFrame) -> Column:
    """A row's name: its id and two hashes of all its columns (rows that agree in all are alike)."""
    whole = [F.col(f"`{c}`") for c in docs.columns]
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64(*whole)), F.hex(F.xxhash64(F.lit(1), *whole)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a recognisable language: no letter, or no language likely enough."""
    model = langid.fit(docs, id_crc() % 4 != 2)
    lang, score = unused(docs.columns, "lang_pred"), unused(docs.columns, "lang_score")
    out = langid.identify(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return out.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject toxic documents. Learned from all labels of documents that reach this stage."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.lit(True))
    score = unused(docs.columns, "toxicity")
    out = toxicity.score(docs, model, keep=tuple(docs.columns), name=score)
    return out.where(F.col(score) < MAX_TOXICITY).select(*docs.columns)


def once(docs: DataFrame, keys: DataFrame, key: str, *more: str) -> DataFrame:
    """The rows of ``docs`` whose row key is in ``keys`` (key, rows, more...), one row a key, with columns ``more``."""
    rows, hold = unused([*docs.columns, *more], "rows"), unused([*docs.columns, *more], "key")
    found = docs.withColumn(hold, row_key(docs)).join(keys.select(F.col(key).alias(hold), F.col("rows").alias(rows), *more), hold)
    out = found.where(F.col(rows) == 1)
    if not keys.where("rows > 1").isEmpty():  # rows that agree in every column
        out = out.unionByName(found.where(F.col(rows) > 1).dropDuplicates([hold]))
    return out.select(*docs.columns, *more)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of exact or near copies."""
    named = docs.select(F.struct(F.col("doc_id").alias("doc_id"), row_key(docs).alias("key")).alias("name"), "text")
    found = simhash.near_copies(named, id="name")
    kept = checkpoint(found.where("name = component_id").groupBy("name.key").agg(F.count(F.lit(1)).alias("rows")))
    return once(docs, kept, "key")


def whole_copies(planned: DataFrame) -> DataFrame:
    """Rows (id, copies, rows): how often an id's rows are repeated together, rounded so that the words of a source come near
    its plan. A row gets its planned share of copies rounded down, or one more when the words that its source is still owed call
    for it. The debt is carried along the rows of a source in a task, so it stays near half of a long document there."""

    def run(batches):
        owed: dict = {}
        for p in batches:
            copies = []
            for source, size, words in zip(p["source"], p["size"].tolist(), p["taken"].tolist()):
                source = None if source is None or source != source else source
                debt = owed.get(source, 0) + words
                least = words // max(size, 1)
                n = least + (size > 0 and words > least * size and 2 * (debt - least * size) >= size)
                owed[source] = debt - n * size
                copies.append(int(n))
            p["copies"] = copies
            yield p[["id", "copies"]]

    runs = planned.select("row", "id", "source", "size", "taken").repartition(partitions(planned.sparkSession), F.expr("row div 1024")).sortWithinPartitions("row")
    return runs.mapInPandas(run, f"id {planned.schema['id'].dataType.simpleString()}, copies long").groupBy("id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights: the copies that the mix takes, rounded within each source."""
    named = docs.select(row_key(docs).alias("key"), "source", "text")
    copies, copy = unused(docs.columns, "copies"), unused(docs.columns, "copy")
    taken = whole_copies(mixing.taken(*mixing.mix(named, id="key"))).where("copies > 0")
    taken = checkpoint(taken.select(F.col("id").alias("key"), F.col("copies").cast("int").alias(copies), "rows"))
    return once(docs, taken, "key", copies).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and decode its ids: the other columns, n_tokens, ids, ids_sha256 and decoded_sha256 (which replace columns called so)."""
    from public_tokenizers import path

    decoded = unused(docs.columns, "decoded")
    out = bpe.round_trip(docs, bpe.Vocabulary(path("word_bpe_49k.json")), out=decoded)
    made = {"text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    extra = [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256")]
    return out.select(*[c for c in docs.columns if c.lower() not in made], *extra)


STAGES = [("language_id", language), ("toxicity", toxic), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("bpe", tokens)]

#: SQL cannot express trained models or fingerprint components; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to and read from the shared folder. A stage's rows are removed
    when the next one's are written; the last ones stay for the caller to read."""
    docs = table(spark, sf_dir, "documents")
    where = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            remove(spark, f"{where}/{before}")
        before = name
    return docs
