"""Roll-ups, merges of human input, and ordered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def auto_resolve(rows: DataFrame, group: str, done: Column, text: str) -> DataFrame:
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(done).alias("resolved"), F.count_if(~done).alias("remaining"),
        F.sum(F.when(~done, F.char_length(text)).otherwise(0)).cast("long").alias("remaining_chars"),
    )


def plugin_summary(coverage: DataFrame, resolved: DataFrame, key: str = "plugin") -> DataFrame:
    """Left join (case ignored) with combined shares."""
    r = resolved.select(F.lower(key).alias("_k"), "resolved", "remaining")
    df = coverage.withColumn("_k", F.lower(key)).join(r, "_k", "left").drop("_k")
    got = F.coalesce("resolved", F.lit(0))
    return df.withColumn("resolved", got).withColumn("remaining", F.coalesce("remaining", F.lit(0))).withColumn("final_ratio", F.round(X.percent(F.col("translated") + got, F.col("total")), 6))


def upsert(existing: DataFrame, detected: DataFrame, key: str, human: str, stats: list[str]) -> DataFrame:
    """Full outer merge that never loses what a person entered: retired rows stay with zero statistics."""
    e = existing.select(F.lower(key).alias("_k"), F.col(key).alias("_e"), human)
    d = detected.select(F.lower(key).alias("_k"), F.col(key).alias("_d"), *stats)
    out = e.join(d, "_k", "full")
    return out.select(F.coalesce("_e", "_d").alias(key), F.coalesce(human, F.lit("")).alias(human), *[F.coalesce(s, F.lit(0)).alias(s) for s in stats])


def flag_members(rows: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Add a boolean: whether the key (case ignored) is among ``members``."""
    m = members.select(F.lower(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    return rows.withColumn("_k", F.lower(key)).join(m, "_k", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_k", "_in")


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Human edits replace Japanese, tag the notes and clear the check; all other columns stay."""
    e = edits.select(*keys, F.col("japanese").alias("_new"))
    df = rows.join(e, keys, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("japanese"))
    return df.withColumn("notes", F.when(changed, "SJPTS_ModifiedByUser").otherwise(F.col("notes"))).withColumn("translation_check", F.when(changed, "").otherwise(F.col("translation_check"))).withColumn("japanese", F.when(changed, F.col("_new")).otherwise(F.col("japanese"))).drop("_new")


def detail_counts(details: DataFrame, category: str, item: str) -> DataFrame:
    return details.groupBy(category, item).agg(F.count(F.lit(1)).alias("n"))


def histogram_label(counts: DataFrame, group: str, reason: str, n: str = "n") -> DataFrame:
    """One text a group: "reason n" parts by count, most first."""
    part = F.struct((-F.col(n)).alias("o"), F.col(reason).alias("r"), F.concat_ws(" ", F.col(reason), F.col(n).cast("string")).alias("t"))
    return counts.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(part))["t"], ", ").alias("label"))


def missing(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.select(F.lower(key).alias(key)).subtract(found.select(F.lower(key).alias(key)))


def folder_guard(rows: DataFrame, plugin: str, path: str) -> DataFrame:
    """Add ``in_folder``: whether the row's plugin is the name of the folder its file lies in (case ignored)."""
    folder = F.element_at(F.split(path, "/"), -2)
    return rows.withColumn("in_folder", F.lower(plugin) == F.lower(folder))


def group_by_text(rows: DataFrame, text: str, id: str) -> DataFrame:
    """One row a distinct text with its ids: what is asked once and answered for all."""
    return rows.groupBy(text).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("first_id"))


def not_player_facing(effects: DataFrame, items: DataFrame, perks: DataFrame, spells: DataFrame) -> DataFrame:
    """Record keys that players never see.

    effects (key, load_order, hidden) and items (key, load_order, not_playable): the last contributor decides;
    perks (key, hidden, playable): any contributor; spells (key, effect): ability spells whose effects are all hidden.
    """
    e = effects.groupBy("key").agg(F.max_by("hidden", "load_order").alias("off"))
    i = items.groupBy("key").agg(F.max_by("not_playable", "load_order").alias("off"))
    p = perks.groupBy("key").agg(F.bool_or(F.col("hidden") | ~F.col("playable")).alias("off"))
    s = spells.join(e.select(F.col("key").alias("effect"), F.col("off").alias("_off")), "effect", "left").groupBy("key").agg(F.bool_and(F.coalesce("_off", F.lit(False))).alias("off"))
    out = e.unionByName(i).unionByName(p).unionByName(s)
    return out.where("off").select("key").distinct()
