"""The bilingual corpus: sources and tiers, the exact dictionary, imports, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .overlay import first_by, first_rows

# --- Fixed values ---------------------------------------------------------------------------
TIERS = {"override": -1, "vanilla": 0, "reference": 1, "dsd": 2, "imported": 2}
OTHER_TIER = 2
EXACT_METHODS = {"dsd": "SJPTS_AutoCorpusDsd", "imported": "SJPTS_AutoCorpusImported", "reference": "SJPTS_AutoCorpusReferenceTaiyaku", "override": "SJPTS_AutoCorpusOverride"}
OTHER_EXACT = "SJPTS_AutoCorpus"
# ----------------------------------------------------------------------------------------------


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def tier(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(TIERS), kind), F.lit(OTHER_TIER))


def exact_method(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(EXACT_METHODS), kind), F.lit(OTHER_EXACT))


def best_tier(rows: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    return rows.groupBy(*keys).agg(F.coalesce(F.min(tier(F.col(kind))), F.lit(OTHER_TIER)).alias("tier"))


def exact_dictionary(corpus: DataFrame, exclusions: DataFrame, overrides: DataFrame) -> DataFrame:
    """One Japanese text a trimmed English key.

    corpus: row_id, english, japanese, kind, type. The lowest tier wins, then the first row; a key is an NPC name if any
    row of it is. Imported and patch entries of one word whose Japanese has a particle are dropped, excluded
    keys too; overrides win over all.
    """
    one_word = ~X.trim(F.col("english")).contains(" ")
    loose = F.col("kind").isin("imported", "dsd") & one_word & F.col("japanese").rlike(f"[{X.PARTICLES}]")
    kept = corpus.where(~loose).withColumn("key", X.trim(F.col("english"))).where("key <> '' and japanese <> ''")
    kept = kept.join(exclusions.select("key"), "key", "left_anti")
    rows = kept.select("key", "japanese", "kind", tier(F.col("kind")).alias("tier"), "row_id", (F.col("type") == "NPC_ FULL").alias("npc"))
    over = overrides.select(X.trim(F.col("english")).alias("key"), "japanese", F.lit("override").alias("kind"), F.lit(-1).alias("tier"), F.lit(-1).cast("long").alias("row_id"), F.lit(False).alias("npc"))
    best = F.min_by(F.struct("japanese", "kind", "tier"), F.struct("tier", "row_id"))
    return rows.unionByName(over).groupBy("key").agg(best.alias("b"), F.bool_or("npc").alias("npc_name")).select("key", "b.*", "npc_name")


def exact_lookup(records: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Left join on the trimmed text; names of persons take only keys that are seen as such. Adds ``exact`` (japanese, method)."""
    d = dictionary.select("key", F.struct("japanese", exact_method(F.col("kind")).alias("method")).alias("exact"), "npc_name")
    out = records.withColumn("key", X.trim(F.col("text"))).join(d, "key", "left")
    allowed = (F.col("record_type") != "NPC_ FULL") | F.col("npc_name")
    return out.withColumn("exact", F.when(allowed, F.col("exact"))).drop("key", "npc_name")


def import_entries(imported: DataFrame, candidates: DataFrame) -> DataFrame:
    """Imported pairs that some candidate asks for by (type, english), in Japanese; the latest file wins."""
    wanted = candidates.select("type", "english").distinct()
    kept = imported.where(X.contains_japanese(F.col("japanese"))).join(wanted, ["type", "english"], "left_semi")
    return kept.groupBy("plugin", "type", "english").agg(F.max_by("japanese", F.struct("file_rank", "row_id")).alias("japanese"))


def mismatched_imports(imported: DataFrame, candidates: DataFrame, least: int = 20, share: float = 0.1) -> DataFrame:
    """Imports that hardly match: at least ``least`` entries and under ``share`` of them asked for."""
    wanted = candidates.select("type", "english").distinct().withColumn("hit", F.lit(1))
    per = imported.join(wanted, ["type", "english"], "left").groupBy("plugin").agg(F.count(F.lit(1)).alias("entries"), F.count("hit").alias("matched"))
    return per.where((F.col("entries") >= least) & (F.col("matched") < share * F.col("entries")))


def source_summary(rows: DataFrame, key: str, kind: str = "kind", source: str = "source", top: int = 4) -> DataFrame:
    """kind:source×n for the ``top`` groups by count, then the number of rows in other groups."""
    per = rows.groupBy(key, kind, source).agg(F.count(F.lit(1)).alias("n"))
    head = first_rows(per, [key], [F.desc("n"), F.asc(kind), F.asc(source)], top)
    name = F.concat(F.col(kind), F.lit(":"), F.col(source), F.lit("×"), F.col("n").cast("string"))
    text = head.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(kind).alias("k"), F.col(source).alias("s"), name.alias("t")))).alias("l"), F.sum("n").alias("shown"))
    total = per.groupBy(key).agg(F.sum("n").alias("total"))
    rest = F.col("total") - F.col("shown")
    body = F.array_join("l.t", ", ")
    return text.join(total, key).select(key, F.when(rest > 0, F.concat(body, F.lit(", other "), rest.cast("string"))).otherwise(body).alias("summary"))


def merge_hints(own: DataFrame, extra: DataFrame, key: str = "english") -> DataFrame:
    """Own hints, then extra ones for other keys."""
    return own.unionByName(extra.join(own.select(key), key, "left_anti").select(*own.columns))


def best_hints(hints: DataFrame) -> DataFrame:
    """The most trusted hint of each English text; the first file wins a tie. hints: english, japanese, priority, file_rank."""
    return first_by(hints, ["english"], [F.asc("priority"), F.asc("file_rank"), F.asc("japanese")])
