"""Key phrases of a group of texts: n-gram frequencies, scores, and a greedy choice without containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import checkpoint

# --- Fixed values ---------------------------------------------------------------------------
LEAST_LOCAL, LONGEST, TOP = 2, 5, 10
STOP_WORDS = (
    "a an the of to by in on at as into onto upon over under above below between among through during before after about against "
    "without within along across behind beyond except up down off out once again further then than and or but nor for with from if "
    "is are was were be been being am do does did has have had can could will would shall should may might must this that these those "
    "it its itself he him his himself she her hers herself they them their theirs themselves we us our ours ourselves i me my mine "
    "myself you your yours yourself yourselves who whom whose which what all any both each few more most other some such no not only "
    "own same so too very when where why how there here"
).split()
# ----------------------------------------------------------------------------------------------


def grams(texts: DataFrame, id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Distinct n-grams of every text: id, keep..., gram."""
    return texts.select(id, *keep, F.explode(F.array_distinct(X.ngrams(X.phrase_tokens(F.col(text)), LONGEST))).alias("gram"))


def frequencies(texts: DataFrame, id: str, text: str) -> DataFrame:
    """In how many texts each n-gram occurs, over all texts, once for all groups."""
    return grams(texts, id, text).groupBy("gram").agg(F.count(F.lit(1)).alias("gdf"))


def local_counts(texts: DataFrame, group: str, text: str) -> DataFrame:
    """Occurrences of each n-gram in the distinct texts of a group."""
    distinct = texts.select(group, text).distinct()
    g = distinct.select(group, F.explode(X.ngrams(X.phrase_tokens(F.col(text)), LONGEST)).alias("gram"))
    return g.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("local"))


def scored(local: DataFrame, global_: DataFrame, n: int) -> DataFrame:
    """Phrases that pass the gates with score local * (ln((N + 1) / (gdf + 1)) + 1)."""
    w = F.split("gram", " ")
    ok = (F.col("local") >= LEAST_LOCAL) & ~F.forall(w, lambda x: F.lower(x).isin(STOP_WORDS)) & F.col("gram").rlike(r"^\p{Lu}")
    score = F.col("local") * (F.log((F.lit(float(n)) + 1) / (F.col("gdf") + 1)) + 1)
    return local.where(ok).join(global_, "gram").withColumn("score", score)


def key_phrases(scores: DataFrame, group: str, known: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each group: by score, then more words, then text, each that neither holds nor is held by a chosen one.
    Phrases in ``known`` (gram) are left out.

    The walk goes in rounds: each takes the first phrase of every group that no chosen one excludes, a grouped minimum; what is
    chosen is at most ``top`` phrases a group, joined to the rest by the group. No phrase is left out of the walk.
    """
    if known is not None:
        scores = scores.join(known, "gram", "left_anti")
    scores = checkpoint(scores)
    place = F.struct((-F.round("score", 9)).alias("s"), (-F.size(F.split("gram", " "))).alias("n"), "gram")
    chosen, last = None, 0
    for _ in range(top):
        left = scores
        if chosen is not None:
            taken = chosen.groupBy(group).agg(F.collect_list("gram").alias("taken"))
            left = scores.join(taken, group, "left")
            left = left.where(F.forall(F.coalesce("taken", F.array().cast("array<string>")), lambda t: ~F.contains(t, F.col("gram")) & ~F.contains("gram", t))).drop("taken")
        best = left.groupBy(group).agg(F.min_by(F.struct(*scores.columns), place).alias("b")).select("b.*")
        chosen = checkpoint(best if chosen is None else chosen.unionByName(best))
        now = chosen.count()
        if now == last:
            break
        last = now
    return chosen
