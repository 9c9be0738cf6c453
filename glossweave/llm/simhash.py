"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within ``2 * half`` bits have a common neighbour within ``half`` bits
of each. Every distinct fingerprint emits all variants within ``half`` bits, the variants are
shuffled, and fingerprints that meet on one are linked after their distance is verified.
Equal fingerprints are one node from the start, so a group of copies of any size costs one row,
and a variant meets at most ``1 + 64`` (for ``half=1``) distinct fingerprints.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; rows
with equal ids stay separate rows; a null id is never a component's name unless the component
has no other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded, checkpoint, components, map_texts
from .parsing import mix64

SEED = 42  # fixed by the contract
#: Share of differing bits of the 5-word shingles' fingerprint up to which a pair is a candidate: texts alike by 0.8 differ in 15.1% of
#: the bits (the angle of a cosine of 8/9, over pi), with a deviation of 1.6% for 512 bits; one in a thousand of them differs more.
LIMIT = 0.2
#: Least Jaccard similarity of 5-word shingles of copies, and those shingles' words.
LEAST, SHINGLE = 0.8, 5
#: Bands of 32 bits, and the words of the shingles that they are made from.
BANDS, WIDTH = 16, 2
#: Fingerprints compared with each before the rest of the pairs that meet are; it does not affect results.
NEAREST = 3
#: Others that a fingerprint has met most often, of which the nearest are taken; it does not affect results.
MEETINGS = 6
#: Meetings up to which a fingerprint is compared with all others that it meets, without bounds; it does not affect results.
QUIET = 64
#: Parts of the shingle hashes by which the common shingles of two texts are bounded; it does not affect results.
PARTS = 32


#: Odd steps that make further hashes of a shingle out of its first one.
_STEP = 0x9E3779B97F4A7C15


def fingerprint(text: str | None, width: int = 3, words: int = 1) -> np.ndarray:
    """The fingerprint of one whole text as ``words`` signed 64-bit integers."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not tokens:
        return np.zeros(words, "<i8")
    if len(tokens) <= width:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64 * words, np.int64)
    steps = np.array([_STEP * k & (1 << 64) - 1 for k in range(1, words)], np.uint64)
    rows = (1 << 15) // words  # bounded memory for any length
    for at in range(0, len(h), rows):
        part = h[at : at + rows, None]
        block = np.concatenate([part, mix64(part + steps)], axis=1) if words > 1 else part
        bits = np.unpackbits(np.ascontiguousarray(block, "<u8").view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",), words: int = 1) -> DataFrame:
    """Columns ``keep`` and ``fp`` (``fp0``, ``fp1``... for several words), longs, of every row."""
    names = ["fp"] if words == 1 else [f"fp{k}" for k in range(words)]
    fields = [T.StructField(n, T.LongType()) for n in names]
    return map_texts(docs, text, keep, fields, lambda texts: np.stack([fingerprint(t, width, words) for t in texts], axis=1))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; a shorter text is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = map(b" ".join, zip(*(tokens[i:] for i in range(width)))) if len(tokens) > width else [b" ".join(tokens)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64)).view("<i8")


def similar(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (a, b) whose whole texts have that Jaccard similarity of shingles. ``texts``: fp, text, of which equal ``fp`` have equal text."""
    needed = bounded(checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()))
    fields = [T.StructField("shingles", T.ArrayType(T.LongType()))]
    once = texts.join(needed, "fp", "left_semi").dropDuplicates(["fp"])
    sets = checkpoint(map_texts(once, "text", ("fp",), fields, lambda texts: [[shingles(t) for t in texts]]))
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    x, y = F.size("x"), F.size("y")
    both = both.where(F.least(x, y) >= F.lit(least) * F.greatest(x, y)).withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") >= F.lit(least) * (x + y - F.col("common"))).select("a", "b")


def of_two(rows: DataFrame, place: str, root: str) -> DataFrame:
    """The rows of those places that hold more than one root."""
    here = Window.partitionBy(place)
    both = rows.withColumn("low", F.min(root).over(here)).withColumn("high", F.max(root).over(here))
    return both.where("low <> high").drop("low", "high")


def reach(nodes: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """What bounds the similarity of every distinct ``fp`` of ``nodes`` with any other: ``size`` (shingles), ``most`` and ``parts``.

    A shingle that no other node has cannot be common. With ``shared`` other ones, a partner of ``s`` shingles has a Jaccard
    similarity of at most ``shared / (s + size - shared)``, which falls below ``least`` when ``s > most``. ``parts`` counts the
    shared shingles by their hash in ``PARTS`` parts, for ``alike``; it is null if a count is too large for it.
    """
    needed = bounded(checkpoint(nodes.select("fp").distinct()))
    fields = [T.StructField("shingles", T.ArrayType(T.LongType()))]
    once = texts.join(needed, "fp", "left_semi").dropDuplicates(["fp"])
    sets = checkpoint(map_texts(once, "text", ("fp",), fields, lambda texts: [[shingles(t) for t in texts]]))
    rows = sets.select("fp", F.explode("shingles").alias("s"))
    alone = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp")).where("n = 1")
    part = F.pmod("s", F.lit(PARTS)).cast("int").alias("part")
    marks = rows.select("fp", part, F.lit(1).alias("w")).unionByName(alone.select("fp", part, F.lit(-1).alias("w")))
    counts = marks.groupBy("fp", "part").agg(F.sum("w").alias("shared"), F.count_if(F.col("w") > 0).alias("size"))
    per = counts.groupBy("fp").agg(F.sum("size").alias("size"), F.sum("shared").alias("shared"), F.max("shared").alias("top"), F.map_from_entries(F.collect_list(F.struct("part", "shared"))).alias("by"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0)).cast("short"))
    # a whole number too large by at most one: rounding never rules out a pair
    most = F.ceil(F.col("shared") / F.lit(least) - (F.col("size") - F.col("shared")))
    return per.select("fp", "size", most.alias("most"), F.when(F.col("top") < 1 << 15, parts).alias("parts"))


def alike(a: str, b: str, least: float = LEAST) -> Column:
    """Whether two nodes of ``reach`` (columns with those prefixes; null: not known) can be alike: no more is common than the lesser count of every part."""
    fits = (F.col(b + "size") <= F.col(a + "most")) & (F.col(a + "size") <= F.col(b + "most"))
    common = F.aggregate(F.zip_with(a + "parts", b + "parts", lambda x, y: F.least(x, y)), F.lit(0), lambda sum, x: sum + x)
    # one more than the count that is needed, so that rounding never rules out a pair
    enough = (common + 1) * (1 + least) >= F.lit(least) * (F.col(a + "size") + F.col(b + "size"))
    return F.coalesce(fits, F.lit(True)) & F.coalesce(enough, F.lit(True))


def masks(half: int) -> list[int]:
    """Signed 64-bit masks of at most ``half`` bits; the first is 0."""
    out = [sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough to reach every one within ``radius``.

    All members of an even-radius variant lie within ``radius`` of each other, so each is tied to the
    variant's least member; every pair within ``radius`` is then connected by such ties.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: the ball is split in two halves")
    flips = F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)]))
    ball = fps.select("fp").distinct().select("fp", flips.alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), "fp")
    met = ball.withColumn("a", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``id``, ``fp`` and ``component_id`` (the least id of its component)."""
    fps = checkpoint(fingerprints(docs, text, width, (id,)))  # a few bytes a document, read several times
    return named(fps, components(links(fps, radius)), id)


def named(fps: DataFrame, roots: DataFrame, id: str) -> DataFrame:
    """Every row of ``fps`` with the least id of its fingerprint's component."""
    classes = fps.groupBy("fp").agg(F.min(id).alias("least"))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(names, "root").select("fp", "component_id"), "fp").select(id, "fp", "component_id")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, limit: float = LIMIT) -> DataFrame:
    """One row per document: ``id``, ``fp`` and ``component_id``, for copies with a few edits.

    A fingerprint of ``bands`` (an even number) bands of 32 bits is made of shingles of ``width`` words. Every band emits its ball of half
    radius 1, so fingerprints that differ in at most 2 bits of some band meet; a pair that meets is a
    candidate if fingerprints of as many bits of the five-word shingles differ in at most that share ``limit``, and is linked if the five-word shingles of
    the whole texts have a Jaccard similarity of ``LEAST``. Equal texts are one node, named ``fp`` (a 64-bit hash of the text).
    First each fingerprint is compared with the ``NEAREST`` nearest of those that are most often first or just before it in a meeting place, which
    joins most of a large group in rows in proportion to its size; then all pairs that meet and are still in different
    components are compared, so every similar pair that meets ends in one component. Of two fingerprints with more than ``QUIET`` meetings
    left, only those are compared that can be alike by their numbers of shingles that no other such text has, or by parts (``reach``).

    Defined results: null and empty texts are one node; a text under five words is one shingle; rows with equal ids stay
    separate rows; an empty table gives an empty table; other columns are not read.
    """
    words = [f"fp{k}" for k in range(bands // 2)]
    texts = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("fp", F.xxhash64("text"))
    finer = [f"s{k}" for k in range(len(words))]
    fields = [T.StructField(n, T.LongType()) for n in [*words, *finer]]
    both_widths = lambda t: np.concatenate([fingerprint(t, width, len(words)), fingerprint(t, SHINGLE, len(words))])
    fps = checkpoint(map_texts(texts, "text", (id, "fp"), fields, lambda texts: np.stack([both_widths(t) for t in texts], axis=1)))
    texts = texts.select("fp", "text")
    nodes = fps.select("fp", *words, *finer).dropDuplicates(["fp"])
    band = lambda k: F.shiftrightunsigned(F.col(words[k // 2]), 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(k << 32))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])

    def close(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("fp").alias(x), *[F.col(n).alias(x + n) for n in finer])
        apart = [F.bit_count(F.col("a" + n).bitwiseXOR(F.col("b" + n))) for n in finer]
        return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("apart", sum(apart[1:], apart[0])).where(F.col("apart") <= int(limit * 64 * len(finer))).select("a", "b", "apart")

    ball = nodes.select("fp", F.explode(F.array(*[band(k) for k in range(bands)])).alias("band"))
    ball = ball.select("fp", "band", F.posexplode(flips).alias("at", "flip")).select("fp", F.col("at").cast("byte").alias("at"), F.col("band").bitwiseXOR(F.col("flip")).alias("variant"))
    here = Window.partitionBy("variant")
    met = ball.withColumn("n", F.count(F.lit(1)).over(here)).withColumn("low", F.min("at").over(here)).withColumn("high", F.max("at").over(here))
    # few rows but those of copies: most variants have one fingerprint; equal bands need not meet again where both are flipped alike
    met = met.where("n > 1 AND (low < high OR low = 0)").select("fp", "variant", "at", "n")
    # an original meets more of its copies than they meet each other, so the one that meets most comes first in its places.
    # What belongs to a fingerprint joins it while its places (at most 33 a band) are one row, and is unfolded with them.
    held = checkpoint(met.groupBy("fp").agg(F.sum("n").alias("weight"), F.collect_list(F.struct("variant", "at", "n")).alias("places")))
    place = Window.partitionBy("variant").orderBy(F.desc("weight"), "fp")
    pairs = held.select("fp", "weight", F.explode("places.variant").alias("variant")).select(F.col("fp").alias("b"), F.first("fp").over(place).alias("first"), F.lag("fp").over(place).alias("last"))
    pairs = pairs.select("b", F.explode(F.array_distinct(F.array("first", "last"))).alias("a")).where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("met"))
    often = Window.partitionBy("b").orderBy(F.desc("met"), "a")
    pairs = pairs.withColumn("rank", F.row_number().over(often)).where(F.col("rank") <= MEETINGS).select("a", "b")
    ranked = close(pairs).withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("apart", "a")))
    nearest = checkpoint(ranked.where(F.col("rank") <= NEAREST).select("a", "b"))
    ties = checkpoint(similar(nearest, texts))

    tied = components(ties)
    rooted = held.join(tied, held.fp == tied.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), F.explode("places").alias("x")).select("fp", "root", "x.*")
    mixed = of_two(rooted, "variant", "root").groupBy("fp", "root").agg(F.sum("n").alias("n"), F.collect_list(F.struct("variant", "at")).alias("places"))
    mixed = checkpoint(mixed)
    bounds = reach(mixed.where(F.col("n") > QUIET), texts)
    known = mixed.drop("n").join(bounds, "fp", "left").withColumn("x", F.explode("places")).select("fp", "root", "size", "most", "parts", "x.variant", "x.at")
    known = known.withColumn("low", F.min(F.coalesce("size", F.lit(0))).over(here)).withColumn("high", F.max(F.coalesce("most", F.lit((1 << 63) - 1))).over(here))
    known = of_two(known.where("size IS NULL OR most >= low AND size <= high").drop("low", "high"), "variant", "root")
    side = lambda x: known.select("variant", *[F.col(c).alias(x + c) for c in known.columns if c != "variant"])
    # of two bands one bit apart, or two, that meet twice, and of equal ones, one meeting is enough
    other = (F.col("afp") < F.col("bfp")) & (F.col("aroot") != F.col("broot")) & ((F.col("aat") < F.col("bat")) | (F.col("aat") + F.col("bat") == 0))
    rest = side("a").join(side("b"), "variant").where(other & alike("a", "b")).select(F.col("afp").alias("a"), F.col("bfp").alias("b")).distinct()
    rest = checkpoint(close(rest).select("a", "b"))
    edges = ties.unionByName(similar(rest, texts))
    return named(fps.select(id, "fp"), components(edges), id)
