"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases whose borders depend only on a few symbols around
them: runs of one symbol are folded, deterministic coin tossing (position and value of the lowest
bit in which a symbol differs from the one before it) shrinks the alphabet to six labels without
equal neighbours, and local maxima of the labels start phrases. A phrase is named by a hash of its
contents; names are the symbols of the next level. Equal substrings therefore get equal names inside, at
whatever offset. The fingerprint is the smallest names of level ``LEVEL``.

Defined results: null counts as empty; an empty text has an empty fingerprint, alike (1.0) to an
empty one and unlike (0.0) any other; equal texts have equal fingerprints; texts are parsed whole;
rows with equal ids stay separate, ordered by text; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL, KEEP = 2, 64
#: Texts are parsed together in groups of about so many characters.
GROUP_CHARS = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit hash: two rounds of shift-xor and odd multiplication."""
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(29))) * _FOLD
    return x ^ (x >> np.uint64(32))


def _coin_table(n: int) -> np.ndarray:
    """coin[a * n + b]: 2 * (lowest differing bit) + (that bit of b), for symbols below n."""
    a, b = np.divmod(np.arange(n * n), n)
    d = a ^ b
    low = np.zeros(n * n, np.int64)
    for bit in range(8, -1, -1):
        low[(d >> bit) & 1 == 1] = bit
    return (2 * low + ((b >> low) & 1)).astype(np.uint8)


_COIN = {n: _coin_table(n) for n in (256, 128, 16, 8)}


def _reduce(labels: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """One round of coin tossing on labels below ``n``; a text's first symbol meets its own complement in bit 0."""
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ 1
    return _COIN[n][before.astype(np.int32) * n + labels]


def _starts(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices where phrases start; ``first`` are the starts of texts, neighbours differ."""
    if symbols.dtype == np.uint8:
        labels = _reduce(symbols, first, 256)  # below 16
    else:
        before = np.empty_like(symbols)
        before[1:] = symbols[:-1]
        before[first] = symbols[first] ^ np.uint64(1)
        d = symbols ^ before
        low = np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = (2 * low + ((symbols >> low) & np.uint64(1))).astype(np.uint8)
        labels = _reduce(labels, first, 128)  # below 14
    labels = _reduce(labels, first, 16)  # below 8
    labels = _reduce(labels, first, 8)  # below 6
    peak = np.zeros(len(labels), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    edge = np.concatenate([first[1:] - 1, first[1:] + 1, [1]])  # borders of texts start and end phrases by themselves
    edge = edge[edge < len(labels)]
    peak[edge] = False
    peak[first] = True
    return np.flatnonzero(peak)


def level_up(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level and where each text starts among them."""
    head = np.empty(len(symbols), bool)
    head[0], head[1:] = True, symbols[1:] != symbols[:-1]
    head[first] = True
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(symbols))).astype(np.uint64)
    first = np.searchsorted(at, first)
    heads = symbols[at]
    starts = _starts(heads, first)
    length = np.diff(np.append(starts, len(heads)))
    place = (np.arange(len(heads)) - np.repeat(starts, length)).astype(np.uint64)
    part = mix64(heads.astype(np.uint64) * _ODD + run + (place << np.uint64(40)) + np.uint64(1))
    return mix64(np.add.reduceat(part, starts) + length.astype(np.uint64)), np.searchsorted(starts, first)


def names(texts: list[str], level: int = LEVEL) -> list[np.ndarray]:
    """The distinct phrase names of ``level``, sorted, of each text (empty: none)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    some = [i for i, r in enumerate(raw) if r]
    out = [np.zeros(0, np.uint64)] * len(texts)
    if not some:
        return out
    sizes = np.array([len(raw[i]) for i in some])
    symbols = np.frombuffer(b"".join(raw[i] for i in some), np.uint8)
    first = np.append(0, np.cumsum(sizes)[:-1])
    for _ in range(level):
        symbols, first = level_up(symbols, first)
    for i, part in zip(some, np.split(symbols, first[1:])):
        out[i] = np.unique(part)
    return out


def sketches(texts: list[str], level: int = LEVEL, keep: int = KEEP) -> list[np.ndarray]:
    """The ``keep`` smallest 32-bit phrase names of each text."""
    return [np.unique((n >> np.uint64(32)).astype(np.uint32))[:keep] for n in names(texts, level)]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated Jaccard similarity of the name sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:keep]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def edited(text: str, after: str) -> str:
    """The last quarter of ``text`` replaced by as many first code points of ``after``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def _bucket(id: Column, cuts: list) -> Column:
    """The number of ``cuts`` at or below ``id``, as a balanced tree of comparisons; null: 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(id < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(id.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def fingerprint_chain(docs: DataFrame, id: str = "doc_id", text: str = "text", level: int = LEVEL, keep: int = KEEP) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    Texts are shuffled once: ids are cut into ranges at quantiles, each range is one partition, and the first
    rows of a range also go to the range before it (the first range's to the last), so every row meets its next.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = df.select("id")
    cuts = ids.agg(F.percentile_approx("id", F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), F.lit(20 * parts))).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    heads = ids.groupBy(_bucket(F.col("id"), cuts).alias("b")).agg(F.count_if(F.col("id").isNull()).alias("nulls"), F.min("id").alias("low")).collect()  # one row per range
    heads = sorted((r["b"], None if r["nulls"] else r["low"]) for r in heads)
    lows, goes = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (b, low) in enumerate(heads):
        lows[b], goes[b] = low, heads[i - 1][0]  # the first range's head goes to the last
    at = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("b"))
    is_head = F.col("id").eqNullSafe(at(lows))
    df = df.withColumn("b", _bucket(F.col("id"), cuts))
    own, also = F.struct(F.col("b").alias("to"), F.lit(False).alias("lead")), F.struct(at(goes).cast("int").alias("to"), F.lit(True).alias("lead"))
    df = df.withColumn("x", F.explode(F.when(is_head, F.array(own, also)).otherwise(F.array(own))))
    df = df.select("id", "text", F.col("x.to").alias("to"), F.col("x.lead").alias("lead"))
    dealt = df.repartitionById(max(1, len(cuts) + 1), F.col("to")).sortWithinPartitions("to", "lead", F.asc_nulls_first("id"), "text")

    def flush(rows: list, nxt: str):
        texts = [t for _, t in rows]
        after = [*texts[1:], nxt]
        new = [edited(t, a) for t, a in zip(texts, after)]
        fps = sketches([*texts, nxt], level, keep)
        eds = sketches(new, level, keep)
        text_of = lambda f: f.astype(">u4").tobytes().hex()
        cols = [
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
            pa.array([text_of(f) for f in fps[:-1]]),
            pa.array([text_of(f) for f in eds]),
            pa.array([likeness(f, e, keep) for f, e in zip(fps, eds)]),
            pa.array([likeness(f, g, keep) for f, g in zip(fps, fps[1:])]),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        rows, size, done = [], 0, False
        for b in batches:
            for i, t, lead in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if done:
                    continue  # further leads with the same id
                if lead or size >= GROUP_CHARS:
                    if rows:
                        yield flush(rows, t)
                    rows, size, done = [], 0, lead
                if not lead:
                    rows.append((i, t))
                    size += len(t)

    out = dealt.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id)
