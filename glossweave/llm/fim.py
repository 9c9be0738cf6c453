"""Fill-in-middle transformation over a distinct-text index.

Equal texts are grouped (by their SHA-256 for the exchange, and by the whole text inside a group), the boundaries of
their tokens are kept once a distinct text as an Elias-Fano list, and documents are joined back to select their two
seeded cuts. Texts that a large share of the documents have are grouped apart: they are combined before the exchange,
and their one index row is repeated over numbered parts among which their documents are dealt and joined. All other texts go
through one exchange with their ids; there a group is a row with the list of its documents, bounded by the share that makes a
text hot, and joining back is unfolding that list.

Defined results: a null text is empty, has no token and stays plain, like every text that holds a mark of the
template; a null id is seeded as an empty one; repeated rows are repeated results, equal ids are cut alike where their
texts are equal; texts of any length are cut whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_texts, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space that ends a token, by code point (fixed by the contract).
_SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)
#: Code points of a text that are looked at together.
_CHUNK = 1 << 20
#: Documents that share one part of a hot text, at least; and the number of hot texts there can be.
PART_ROWS, HOT_TEXTS = 1024, 50_000


def boundaries(text: str) -> np.ndarray:
    """Where the tokens of a text end, in code points: after each run of non-space, and after space at the end."""
    found, before = [], True  # before: the code point before the chunk is space
    for at in range(0, len(text), _CHUNK):
        space = np.isin(np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), "<u4"), _SPACE)
        found.append(at + np.flatnonzero(space & ~np.concatenate(([before], space[:-1]))))
        before = bool(space[-1])
    if text:
        found.append([len(text)])
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list in about 2 + log2(greatest / count) bits a value: a byte with the width of the low parts, the packed
    low parts, then one bit a value at (its high part + its place)."""
    n = len(values)
    if not n:
        return b"\0"
    width = max(0, int(values[-1] // n).bit_length() - 1)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8)
    high = np.zeros(int(values[-1] >> width) + n, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return bytes([width]) + np.packbits(low.ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(index: bytes, n: int, k: int) -> int:
    """The k-th of the n values of an Elias-Fano list, from 1; zero for k = 0."""
    if k <= 0:
        return 0
    width, body = index[0], np.frombuffer(index, np.uint8, offset=1)
    lows = (n * width + 7) // 8
    counts = np.cumsum(np.bitwise_count(body[lows:]), dtype=np.int64)
    byte = int(np.searchsorted(counts, k))
    inside = k - (int(counts[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(body[lows + byte : lows + byte + 1], bitorder="little"))[inside - 1])
    low, first = 0, (k - 1) * width
    for i in range(width):
        low |= ((int(body[(first + i) >> 3]) >> ((first + i) & 7)) & 1) << i
    return ((byte * 8 + bit - (k - 1)) << width) | low


def _index(texts: DataFrame, *more: str) -> DataFrame:
    """Rows of distinct (key, text) and ``more`` with ``n`` and ``cuts``."""

    def run(batch: list) -> list:
        ends = [boundaries(t) for t in batch]
        return [[len(e) for e in ends], [elias_fano(e) for e in ends]]

    fields = [T.StructField("n", T.LongType()), T.StructField("cuts", T.BinaryType())]
    return map_texts(texts, "text", ("key", "text", *more), fields, run)


def distinct_texts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (doc_id, text, n, cuts), the last two computed once for each distinct text.

    A group is keyed by the SHA-256 of its text for the exchange and compared whole inside its key.
    """
    text_of = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), text_of.alias("text")).withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    total = docs.count()
    least = max(PART_ROWS, -(-total // HOT_TEXTS))  # at most HOT_TEXTS texts have so many copies
    hot = checkpoint(counts.where(F.col("copies") >= least).select("key", F.ceil(F.col("copies") / least).cast("int").alias("parts")))
    parts = F.broadcast(hot)
    groups = rows.join(parts, "key", "left_anti").repartition("key").groupBy("key", "text").agg(F.collect_list(F.struct("doc_id")).alias("docs"))
    out = _index(groups, "docs").select(F.explode("docs").alias("d"), "text", "n", "cuts").select("d.doc_id", "text", "n", "cuts")
    if hot.isEmpty():
        return out
    index = _index(rows.join(parts, "key", "left_semi").select("key", "text").distinct()).join(parts, "key")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    part = F.pmod(F.xxhash64("doc_id", "row"), F.col("parts")).cast("int")
    mine = rows.select("doc_id", "key").join(parts, "key").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "key", part.alias("part"))
    return out.unionByName(dealt.join(mine.hint("shuffle_hash"), ["key", "part"]).select("doc_id", "text", "n", "cuts"))


def _drawn(id: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group of the id's seeded hash, as a number."""
    whole = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(whole, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """Rows (doc_id, text, n, form, prefix_chars, middle_chars, output). ``share`` percent of the documents are transformed,
    ``spm`` percent of these suffix first."""
    found = distinct_texts(docs, id, text)
    h = lambda k: _drawn(F.col("doc_id"), seed, k)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h(3) % 100 >= share)
    one, two = h(1) % (F.col("n") + 1), h(2) % (F.col("n") + 1)
    found = found.withColumn("form", F.when(plain, "plain").when(h(4) % 100 < spm, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    # plain rows select nothing: their list does not go to Python
    chosen = cuts(F.when(cut, F.col("cuts")), F.col("n"), F.least(one, two), F.greatest(one, two), docs)
    found = found.withColumn("at", chosen).withColumns({"p": F.when(cut, F.col("at")["p"]), "m": F.when(cut, F.col("at")["m"])})
    piece = lambda a, n: F.substr("text", (a + 1).cast("int"), n.cast("int"))
    prefix, middle = piece(F.lit(0), F.col("p")), piece(F.col("p"), F.col("m") - F.col("p"))
    suffix = piece(F.col("m"), F.char_length("text") - F.col("m"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return found.select("doc_id", "text", "n", "form", F.col("p").alias("prefix_chars"), (F.col("m") - F.col("p")).alias("middle_chars"), output.alias("output"))


def cuts(index: Column, n: Column, first: Column, second: Column, docs: DataFrame) -> Column:
    """The two selected boundaries of each row, struct (p, m); null without an index."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.StructType([T.StructField("p", T.LongType()), T.StructField("m", T.LongType())]))
    def chosen(index: pa.Array, n: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = zip(index.to_pylist(), n.to_pylist(), first.to_pylist(), second.to_pylist())
        got = [(None, None) if x is None else (select(x, n, a), select(x, n, b)) for x, n, a, b in rows]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["p", "m"])

    return chosen(index, n, first, second)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A text with a mark in it is plain, so the marks in the others are the template's."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
