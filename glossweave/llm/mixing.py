"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is a stream of its documents in hashed order, cut into blocks of equal word count.
A source's blocks have its words over their number, so that none is short, and its slots are its target over that length.
Slot k of the mix takes the golden-ratio point frac((k + 1) * phi) through the cumulative
target shares of slots to choose a source (slots beyond a source's number stay empty, and missing ones follow at the end); the slot's rank among the slots of that source, through a
fixed permutation, names the block that it takes. Any prefix of the schedule is mixed to the
target weights within a few blocks.

Defined results: null and empty texts have size 0 and take nothing; null sources are one source,
last; a source without words has target 0; equal rows are separate documents; an empty table
gives an empty table; only the named columns are read; reruns agree row for row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, bounded, ordered

#: The distinct sources are planned on the driver; beyond this many the call is refused.
MAX_SOURCES = 1_000_000
#: 2^64 / golden ratio, odd: the step of the Kronecker sequence in 64-bit fixed point.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 16
#: A source has at least this many blocks (a block a word, if it has fewer words), so that whole blocks come near any target.
LEAST_BLOCKS = 64


def targets(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``cap`` times its size."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, left, free = np.zeros(len(size)), share * size.sum(), np.ones(len(size), bool)
    while free.any():
        out[free] = left * weight[free] / weight[free].sum()
        over = free & (out > cap * size)
        if not over.any():
            break
        out[over] = cap * size[over]
        left, free = left - out[over].sum(), free & ~over
    return out.tolist()


def block_words(total: float, block: int | None) -> int:
    """The block length: ``block``, or the mix in about 2^20 slots, but no block above 2048 words."""
    return block or int(min(2048, max(1, total // (1 << 20))))


def thresholds(goal: list[float]) -> np.ndarray:
    """Upper ends of the sources' shares of the 64-bit circle; the last source with a share ends at its top."""
    top = (1 << 64) - 1
    if not sum(goal):
        return np.zeros(0, np.uint64)
    ends = [min(top, int(c / sum(goal) * 2.0**64)) for c in np.cumsum(goal)]
    last = max(i for i, g in enumerate(goal) if g > 0)
    return np.array([top if i >= last else e for i, e in enumerate(ends)], np.uint64)


def permuted(r: np.ndarray, step: np.ndarray, shift: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(r * step + shift) mod n, exact: in Python integers where the product could overflow."""
    if len(n) and n.max() >= 1 << 31:
        r, step, shift, n = (x.astype(object) for x in (r, step, shift, n))
    return ((r * step + shift) % n).astype(np.int64)


def step_for(n: int) -> int:
    """A step near n / phi without a common divisor with n: r -> r * step mod n permutes 0..n-1."""
    s = max(1, int(n * 0.6180339887498949))
    while math.gcd(s, n) != 1:
        s += 1
    return s


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Plan the mix. Returns (documents, schedule).

    documents: row, id, source, size, source_size, target. schedule: slot, row, offset, words: the
    slot takes ``words`` words of that row from word ``offset`` on. ``weights`` repeat over the
    sources in code-point order.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    df = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id)).alias("_h"))
    df, _, _ = ordered(df, [F.asc_nulls_last("source"), F.col("_h"), F.col("id"), F.col("size")], "size")
    rows = df.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    names, sizes = [r["source"] for r in rows], [int(r["size"]) for r in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    total, base = sum(goal), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
    b = block_words(total, block)
    blocks = [min(s, max(-(-s // b), LEAST_BLOCKS)) for s in sizes]
    slot_goal = [g * n / s if s else 0.0 for g, n, s in zip(goal, blocks, sizes)]
    # one small row a source, joined in the JVM
    plan = [(n, i, int(base[i]), sizes[i], float(goal[i]), *divmod(sizes[i], max(blocks[i], 1))) for i, n in enumerate(names)]
    plan = bounded(spark.createDataFrame(plan, "name string, six int, base long, source_size long, target double, short long, longer long"), "name")
    documents = df.join(plan, F.col("source").cast("string").eqNullSafe(F.col("name")))
    documents = documents.select(F.col("_pos").alias("row"), "id", "source", "size", "source_size", "target", "six", (F.col("_start") - F.col("base")).alias("at"), "short", "longer")
    # the first ``longer`` blocks of a source have one word more than the others' ``short``
    at_block = lambda w: F.expr(f"CASE WHEN {w} < longer * (short + 1) THEN {w} div (short + 1) ELSE longer + ({w} - longer * (short + 1)) div short END")
    starts = lambda k: k * F.col("short") + F.least(k, F.col("longer"))
    pieces = (
        documents.where("size > 0")
        .select("row", "six", "at", "size", "short", "longer", F.explode(F.sequence(at_block("at"), at_block("(at + size - 1)"))).alias("block"))
        .select("row", "six", "block", "at", F.greatest(F.col("at"), starts(F.col("block"))).alias("lo"), F.least(F.col("at") + F.col("size"), starts(F.col("block") + 1)).alias("hi"))
        .select("row", "six", "block", (F.col("lo") - F.col("at")).alias("offset"), (F.col("hi") - F.col("lo")).alias("words"))
    )
    schedule = slots(spark, slot_goal, blocks, cap).hint("merge").join(pieces, ["six", "block"]).select("slot", "row", "offset", "words")
    return documents.drop("six", "at", "short", "longer"), schedule


def slots(spark, goal: list[float], blocks: list[int], cap: float) -> DataFrame:
    """The schedule's slots: slot, six (the source's place), block. Two passes over chunks of slots:
    the first counts each chunk's slots by source, the second ranks them from the sums before it.
    ``goal``: slots of each source, which it gets exactly, rounded, and never above ``cap`` times its blocks."""
    count = math.ceil(sum(goal))
    quota = np.minimum(np.floor(np.array(goal) + 0.5), np.floor(cap * np.array(blocks))).astype(np.int64)
    chunks = -(-count // CHUNK)
    shared = spark.sparkContext.broadcast((thresholds(goal), np.array(blocks, np.int64), np.array([step_for(n) if n else 1 for n in blocks], np.int64), quota))

    def drawn(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(chunk * CHUNK, min(count, (chunk + 1) * CHUNK), dtype=np.int64)
        with np.errstate(over="ignore"):
            point = (k.astype(np.uint64) + np.uint64(1)) * GOLDEN
        return k, np.minimum(np.searchsorted(shared.value[0], point, side="right"), len(shared.value[0]) - 1)

    def counted(batches):
        for p in batches:
            for c in p.id:
                six, n = np.unique(drawn(int(c))[1], return_counts=True)
                yield pd.DataFrame({"chunk": int(c), "six": six.astype("int32"), "n": n})

    def ranked(batches):
        for p in batches:
            for c, before in zip(p.chunk, p.before):
                k, six = drawn(int(c))
                _, n_blocks, steps, most = shared.value
                start = np.zeros(len(n_blocks), np.int64)
                for x in before:
                    start[x["six"]] = x["n"]
                order = np.argsort(six, kind="stable")
                s = six[order]
                first = np.r_[0, np.flatnonzero(np.diff(s)) + 1] if len(s) else np.zeros(0, int)
                within = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
                rank = np.empty(len(s), np.int64)
                rank[order] = start[s] + within
                ok = rank < most[six]
                k, six, rank = k[ok], six[ok], rank[ok]
                n = n_blocks[six]
                yield pd.DataFrame({"slot": k, "six": six.astype("int32"), "block": permuted(rank % n, steps[six], rank // n, n)})

    def added(batches):
        _, n_blocks, steps, _ = shared.value
        for p in batches:
            six, rank = p.six.to_numpy(), p["rank"].to_numpy()
            n = n_blocks[six]
            yield pd.DataFrame({"slot": p.slot, "six": six, "block": permuted(rank % n, steps[six], rank // n, n)})

    per = spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInPandas(counted, "chunk long, six int, n long")
    had = np.zeros(len(goal), np.int64)
    for r in per.groupBy("six").agg(F.sum("n").alias("n")).collect():  # one row a source
        had[r["six"]] = r["n"]
    lack = np.maximum(quota - had, 0)
    extra = pd.DataFrame({"slot": count + np.arange(lack.sum()), "six": np.repeat(np.arange(len(goal)), lack).astype("int32"), "rank": np.repeat(had - np.cumsum(lack) + lack, lack) + np.arange(lack.sum())})
    upto = Window.partitionBy("six").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("n", F.coalesce(F.sum("n").over(upto), F.lit(0))).groupBy("chunk").agg(F.collect_list(F.struct("six", "n")).alias("before"))
    drawn_slots = before.mapInPandas(ranked, "slot long, six int, block long")
    if not len(extra):
        return drawn_slots
    return drawn_slots.unionByName(spark.createDataFrame(extra, "slot long, six int, rank long").mapInPandas(added, "slot long, six int, block long"))


def taken(documents: DataFrame, schedule: DataFrame) -> DataFrame:
    """Documents with ``taken``: the words that the schedule takes of each, repeats counted."""
    sums = schedule.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
