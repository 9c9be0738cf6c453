"""Interface string files: pairs of key and text, merged from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def last_wins(pairs: DataFrame, file: str = "file", key: str = "key", value: str = "value", line: str = "line_no") -> DataFrame:
    """One row a key: its last value, at the place of its first line."""
    return pairs.groupBy(file, key).agg(F.max_by(value, line).alias(value), F.min(line).alias(line))


def merge(english: DataFrame, existing: DataFrame, imported: DataFrame) -> DataFrame:
    """English rows (base, key, english) with Japanese by base (case ignored) and key; an import goes before what exists."""
    k = lambda df, n: df.select(F.lower("base").alias("_b"), "key", F.col("japanese").alias(n))
    df = english.withColumn("_b", F.lower("base")).join(k(existing, "_old"), ["_b", "key"], "left").join(k(imported, "_new"), ["_b", "key"], "left")
    return df.withColumn("japanese", F.coalesce("_new", "_old")).drop("_b", "_old", "_new")


def prefix_match(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Each target's file: the one of the same base name, else the first whose name starts with the target.

    A file's name meets a target by an equal prefix: each name is unfolded into its prefixes of the lengths that open targets
    have, so a target of any length is found and names that share only a beginning do not meet.
    """
    exact = wanted.join(files.select(F.lower("name").alias("_n"), "name"), F.lower("target") == F.col("_n")).groupBy("target").agg(F.min("name").alias("file"))
    rest = wanted.join(exact, "target", "left_anti").withColumn("_h", F.lower("target"))
    lengths = sorted(r["n"] for r in rest.select(F.char_length("_h").alias("n")).distinct().collect())  # lengths of names: a few small numbers
    cut = F.array_distinct(F.array(*[F.when(F.char_length("name") >= n, F.lower(F.substring("name", 1, n))) for n in lengths])) if lengths else F.array().cast("array<string>")
    near = rest.join(files.select("name", F.explode(cut).alias("_h")), "_h")
    return exact.unionByName(near.groupBy("target").agg(F.min("name").alias("file")))


def resolve(rows: DataFrame) -> DataFrame:
    """Add ``resolved``: a key that shows itself and text that needs no translation stay; good Japanese counts; else it is open."""
    own_name = F.lower("english") == F.lower(F.regexp_replace("key", r"^\$", ""))
    keep = own_name | ~X.is_translatable_english(F.col("english"))
    good = X.contains_japanese(F.col("japanese"))
    out = rows.withColumn("resolved", keep | good)
    return out.withColumn("japanese", F.when(keep & ~good, F.col("english")).when(good, F.col("japanese")).otherwise(""))


def output_text(japanese: Column, english: Column) -> Column:
    return F.coalesce(F.nullif(japanese, F.lit("")), english)


def summary(rows: DataFrame, target: str = "target") -> DataFrame:
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("resolved")).alias("untranslated"))


def sections(lines: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """INI lines as (file, section, key, value): comments and blank lines dropped, ``General`` before the first section,
    the last value of a key."""
    df = lines.withColumn("_l", X.trim(F.col(line))).where("_l <> '' and not startswith(_l, ';')")
    name = F.when(F.col("_l").rlike(r"^\[.*\]$"), F.expr("substring(_l, 2, length(_l) - 2)"))
    w = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("section", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("General"))).where(F.contains("_l", F.lit("=")) & name.isNull())
    df = df.withColumn("key", X.trim(F.substring_index("_l", "=", 1))).withColumn("value", X.trim(F.regexp_replace("_l", "^[^=]*=", "")))
    return df.groupBy(file, "section", "key").agg(F.max_by("value", line_no).alias("value"))
