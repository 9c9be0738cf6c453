"""Similar earlier translations: TF-IDF cosine over an inverted index, bonuses, cut-offs and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..plans.session import checkpoint

#: How a query's best is bounded from below: its rarest tokens, and the lightest entries of each.
RAREST, LIGHTEST = 4, 8
MAX_ENTRY, CUTOFF = 500, 0.4  # fixed values
BONUS_PLUGIN, BONUS_TYPE, BONUS_SIGNATURE = 0.06, 0.04, 0.02  # fixed values


def document_frequency(tokens: DataFrame, n: int) -> DataFrame:
    """token, df, idf = ln(N / (df + 1)) + 1, from rows (id, token) without repeats."""
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + 1)) + 1)


def index(entries: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings (id, token, idf), norms (id, norm) and the frequency table of a set of entries."""
    tokens = entries.select(F.col(id).alias("id"), F.explode(X.retrieval_tokens(F.col(text))).alias("token"))
    idf = document_frequency(tokens, entries.count())
    post = tokens.join(idf.select("token", "idf"), "token")
    return post, post.groupBy("id").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm")), idf


def _tokens(rows: DataFrame, id: str, text: str, scope: str | None) -> DataFrame:
    """(id, scope, token) of rows; with a scope, tokens of different scopes differ."""
    token = F.explode(X.retrieval_tokens(F.col(text))).alias("token")
    if scope is None:
        return rows.select(F.col(id).alias("id"), F.lit("").alias("scope"), token)
    out = rows.select(F.col(id).alias("id"), X.blank(F.col(scope).cast("string")).alias("scope"), token)
    return out.withColumn("token", F.concat("scope", F.lit("\x1f"), "token"))


def vectors(rows: DataFrame, id: str, text: str, idf: DataFrame, sizes: DataFrame, scope: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """id, ``more``, norm and terms (weight = idf squared, token; heaviest first) of rows with a token. A token that no entry has
    counts in the norm, with the weight that a document frequency of none gives."""
    tokens = _tokens(rows, id, text, scope).join(idf.select("token", "idf"), "token", "left").join(F.broadcast(sizes) if scope is None else sizes, "scope")
    tokens = tokens.withColumn("w", F.coalesce("idf", F.log(F.col("n").cast("double")) + 1) ** 2)
    held = tokens.groupBy("id").agg(F.sqrt(F.sum("w")).alias("norm"), F.sort_array(F.collect_list(F.struct("w", "token")), asc=False).alias("terms"))
    return held.join(rows.select(F.col(id).alias("id"), *more), "id") if more else held


def _scored(pairs: DataFrame, queries: DataFrame, entries: DataFrame, extra: Column | None) -> DataFrame:
    """Pairs (query, id) with their whole score: each pair's own terms are compared, no list is read."""
    q = queries.select(F.col("id").alias("query"), F.col("norm").alias("q_norm"), "terms", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c not in ("id", "norm", "terms")])
    e = entries.withColumn("tokens", F.col("terms.token")).drop("terms").withColumnsRenamed({c: f"e_{c}" for c in entries.columns if c not in ("id", "norm", "terms")})
    both = pairs.join(q, "query").join(e, "id")
    shared = F.filter("terms", lambda t: F.array_contains(F.col("tokens"), t["token"]))
    cosine = F.aggregate(shared, F.lit(0.0), lambda s, t: s + t["w"]) / (F.col("norm") * F.col("q_norm"))
    return both.select("query", "id", (cosine if extra is None else cosine + extra).alias("score"))


def candidates(queries: DataFrame, entries: DataFrame, share: float = CUTOFF, extra: Column | None = None, most: float = 0.0) -> DataFrame:
    """Pairs (query, id) that may score ``share`` of the query's best, with ``read``, how many postings gave the pair.

    A lower bound of a query's best comes from the lightest entries of its rarest tokens. With the query's terms in falling order of
    weight, an entry whose first shared term is the i-th can reach no more than the terms from i on allow: by their
    common length, and by the greatest contribution that each of them makes in any entry. Terms from where that is under the
    bound on are not read at all, and of the others only the postings of entries that are light enough. Frequent tokens, which
    weigh little, are so left out as a rule. ``extra`` is what a pair's score has besides the cosine, ``most`` its greatest value.
    """
    post = entries.select("id", "norm", F.explode("terms").alias("t")).select("id", "norm", "t.token", "t.w")
    by_norm = Window.partitionBy("token").orderBy("norm", "id")
    light = post.withColumn("n", F.row_number().over(by_norm)).where(F.col("n") <= LIGHTEST).select("token", "id")
    rare = queries.select(F.col("id").alias("query"), F.explode(F.slice("terms", 1, RAREST)).alias("t")).select("query", "t.token")
    near = _scored(rare.join(light, "token").select("query", "id").distinct(), queries, entries, extra)
    floor = near.groupBy("query").agg(F.max("score").alias("floor"))
    peak = post.groupBy("token").agg(F.min("norm").alias("least_norm"))
    terms = queries.select(F.col("id").alias("query"), F.col("norm").alias("q_norm"), F.explode("terms").alias("t")).select("query", "q_norm", "t.token", "t.w")
    terms = terms.join(peak, "token").join(floor, "query", "left")
    rest = Window.partitionBy("query").orderBy(F.desc("w"), F.desc("token")).rowsBetween(0, Window.unboundedFollowing)
    terms = terms.withColumn("tail", F.sum("w").over(rest)).withColumn("tops", F.sum(F.col("w") / F.col("least_norm")).over(rest))
    need = F.coalesce(F.col("floor") * share - most, F.lit(0.0)) - 1e-9
    reach = F.least(F.sqrt("tail"), F.col("tops")) / F.col("q_norm")
    terms = terms.withColumn("need", need).where((F.col("need") <= 0) | (reach >= F.col("need")))
    limit = F.when(F.col("need") <= 0, F.lit(float("inf"))).otherwise(F.col("tail") / (F.col("q_norm") * F.col("need")))
    terms = terms.select("query", "token", limit.alias("limit"))
    met = terms.join(post.select("token", "id", "norm"), "token").where(F.col("norm") <= F.col("limit"))
    return met.groupBy("query", "id").agg(F.count(F.lit(1)).alias("read"))


def similar(queries: DataFrame, entries: DataFrame, q_id: str, q_text: str, e_id: str, e_text: str, limit: int = MAX_ENTRY, share: float = CUTOFF, extra: Column | None = None, most: float = 0.0, more: tuple[str, ...] = (), scope: str | None = None) -> DataFrame:
    """Scores (query, id, score) of at least ``share`` of the query's best, exactly as all pairs that share a token would give them.

    Entries over ``limit`` characters are not returned but count in frequencies. ``more``: columns of both sides that
    ``extra`` reads as q_name and e_name. ``scope``: a column of both sides; a query meets entries of its scope (say its plugin) only, and
    frequencies are the scope's. A null text has no tokens; a query or an entry without a known token has no score.
    """
    sizes = entries.groupBy((F.lit("") if scope is None else X.blank(F.col(scope).cast("string"))).alias("scope")).agg(F.count(F.lit(1)).alias("n"))
    df = _tokens(entries, e_id, e_text, scope).groupBy("scope", "token").agg(F.count(F.lit(1)).alias("df")).join(sizes, "scope")
    idf = checkpoint(df.select("token", (F.log(F.col("n") / (F.col("df") + 1)) + 1).alias("idf")))
    short = checkpoint(vectors(entries.where(F.char_length(e_text) <= limit), e_id, e_text, idf, sizes, scope, more))
    asked = checkpoint(vectors(queries, q_id, q_text, idf, sizes, scope, more))
    scored = _scored(candidates(asked, short, share, extra, most).select("query", "id"), asked, short, extra)
    best = scored.groupBy("query").agg(F.max("score").alias("best"))
    return scored.join(best, "query").where(F.col("score") >= share * F.col("best")).drop("best")


def bonus(same_plugin: Column, type_a: Column, type_b: Column) -> Column:
    signature = lambda t: F.substring_index(t, " ", 1)
    kind = F.when(type_a == type_b, BONUS_TYPE).when(signature(type_a) == signature(type_b), BONUS_SIGNATURE).otherwise(0.0)
    return F.when(same_plugin, BONUS_PLUGIN).otherwise(0.0) + kind


def cut(scores: DataFrame, top: int, share: float = CUTOFF, tie: tuple[str, ...] = ("id",), key: str = "query") -> DataFrame:
    """Scores of at least ``share`` of the key's best, the ``top`` first by score and then ``tie``. Adds ``rank``."""
    by = Window.partitionBy(key)
    kept = scores.withColumn("_max", F.max("score").over(by)).where(F.col("score") >= share * F.col("_max")).drop("_max")
    order = by.orderBy(F.desc(F.round("score", 9)), *tie)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def budget(rows: DataFrame, key: str, order: list[Column], length: Column, limit: int, top: int) -> DataFrame:
    """The longest prefix of each key's rows with at most ``top`` rows and ``limit`` units in all."""
    w = Window.partitionBy(key).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(length).over(run)).withColumn("rank", F.row_number().over(w)).where((F.col("used") <= limit) & (F.col("rank") <= top))


def hint_pool(scores: DataFrame, *keys: str) -> DataFrame:
    """The best score of each pool item over all queries (of its ``keys``, say the plugin)."""
    return scores.groupBy(*keys, "id").agg(F.max("score").alias("score"))


def same_mod_hints(open_: DataFrame, done: DataFrame, id: str, text: str, plugin: str, top: int, share: float = CUTOFF, tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """(plugin, id, score, rank): the translated texts of a plugin that are most like any of its open texts, at most ``top`` of
    those within ``share`` of the plugin's best. ``tie``: columns of ``done`` that order equal scores.

    What is under the share of one query's best is under that of the plugin's best, so only each query's near entries are formed.
    """
    near = similar(open_, done, id, text, id, text, share=share, scope=plugin)
    pool = hint_pool(near.join(done.select(F.col(id).alias("id"), plugin), "id"), plugin)
    extra = [c for c in tie if c != "id"]
    pool = pool.join(done.select(F.col(id).alias("id"), *extra), "id") if extra else pool
    return cut(pool, top, share, tie, plugin)
