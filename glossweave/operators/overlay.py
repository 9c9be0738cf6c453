"""Layered records: which of many contributors wins, and what earlier ones said.

All operators are one shuffle on the record's key; an explicit, total order decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def chains(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], text: str) -> DataFrame:
    """The contributors of each record in load order, those with a blank text left out: keys, ``chain``."""
    kept = rows.where(~X.is_blank(F.col(text)))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("chain"))


def winners(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last contributor of each record, as a partial aggregate: no sort, no window."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_w"))
    return best.select(*keys, "_w.*")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Whole rows: the first of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_files(files: DataFrame, path: str = "path", priority: Sequence[Column] = ()) -> DataFrame:
    """One row a relative path (case ignored): the contributor that comes first in ``priority``."""
    return first_by(files.withColumn("_ci", F.lower(path)), ["_ci"], list(priority)).drop("_ci")


def first_entries(entries: DataFrame, folders: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries of active folders only; per key the latest-loading folder wins, then the last file name, then the first entry."""
    active = entries.join(folders.select("folder", "load_order"), "folder")
    return first_by(active, keys, [F.desc("load_order"), F.desc("file"), F.asc("entry_no")])


def occurrences(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def bind_comments(lines: DataFrame, file: str = "path", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """Attach to each data line of a file the last comment of each kind since the data line before it.

    Comments look like ``; SJPTS kind | notes | original``. Returns file, line_no, line, comments (array).
    """
    is_note = F.col(text).startswith(";")
    before = Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    block = F.coalesce(F.sum((~is_note).cast("int")).over(before), F.lit(0))
    df = lines.withColumn("_block", block)
    part = lambda i: F.regexp_extract(text, r"^; SJPTS (\S+) \| (.*?) \| (.*)$", i)
    notes = df.where(is_note & F.col(text).startswith("; SJPTS "))
    notes = notes.groupBy(file, "_block", part(1).alias("kind")).agg(F.max_by(F.struct(part(2).alias("notes"), part(3).alias("original")), line_no).alias("n"))
    notes = notes.groupBy(file, "_block").agg(F.array_sort(F.collect_list(F.struct("kind", "n.notes", "n.original"))).alias("comments"))
    return df.where(~is_note).join(notes, [file, "_block"], "left").drop("_block")


def precedent(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, is_ja: Column, dual: str | None = None) -> DataFrame:
    """Walk each chain back from its winner to the nearest earlier Japanese text and judge it.

    Its reference is the contributor's own dual-language English, else the nearest earlier English text. If the
    reference equals the winner's text (apart from case and outer space, tags in order) the Japanese is taken;
    if it differs it is skipped; if there is none it is taken for review.
    Returns keys, text, japanese, needs_review, skipped_japanese, skipped_reference; one row a chain with an English winner.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumn("_ja", is_ja)
    own = F.col(dual) if dual else F.lit(None).cast("string")
    df = df.withColumn("_ref", F.coalesce(own, F.last(F.when(~F.col("_ja"), F.col(text)), ignorenulls=True).over(back)))
    df = df.withColumn("_p", F.last(F.when(F.col("_ja"), F.struct(F.col(text).alias("t"), F.col("_ref").alias("r"))), ignorenulls=True).over(back))
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("_n = 1 and not _ja")
    ref, found = F.col("_p.r"), F.col("_p").isNotNull()
    same = X.same_skeleton(ref, F.col(text))
    skip = found & ref.isNotNull() & ~same
    return df.select(
        *keys,
        text,
        F.when(found & (ref.isNull() | same), F.col("_p.t")).alias("japanese"),
        (found & ref.isNull()).alias("needs_review"),
        F.when(skip, F.col("_p.t")).alias("skipped_japanese"),
        F.when(skip, ref).alias("skipped_reference"),
    )


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Whole rows: the first ``n`` of each key in ``order`` (a window group limit prunes before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
