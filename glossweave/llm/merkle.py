"""Merkle manifest of a data set with proofs by coordinate lookup.

Rows are hashed where they are read, and only their digests go on. In each group the leaves stand by id; runs of eight
nodes become the next level, three levels a pass, and the node table (tree, level, place, digest) is written. The
groups' top nodes are the leaves of one more tree. A leaf's proof is found from its place and the size of its group
alone: it explodes the coordinates of its siblings on all levels, joins the node table, orders what it found,
concatenates it and folds it. What is above a group's top is the same for all its leaves and is looked up once a group.

Levels that the whole table has few nodes of (counted from the groups' sizes) are joined by broadcast, the levels
below by an exchange on the coordinate, where no node is the sibling of more than a small share of the leaves.

Defined results: a null field is ``-``; null ids come first; ties on the id stand by their digests; a null group is a group
and comes first; a lone leaf is its own top with an empty proof; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, BROADCAST_ROWS, bounded, checkpoint, ordered

#: Nodes in a run (fixed by the contract), as bits of a place.
RUN_BITS = 3
#: More levels than any table can have.
LEVELS = 21
#: Groups whose proofs (under 2 kB each) are broadcast at most.
BROADCAST_GROUPS = 8_000
_NODE = "tree", "level", "place", "digest"


def digest(hexes: Column) -> Column:
    """The hash of concatenated hex digests (or fields), in binary."""
    return F.unhex(F.sha2(hexes.cast("binary"), 256))


def hexed(x: Column) -> Column:
    return F.lower(F.hex(x))


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def lowered(text: Column) -> Column:
    """The tampering of the contract: A-Z in lower case."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def size_at(n: Column, level: Column | int) -> Column:
    """Nodes on a level of a tree with n leaves."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.call_function("shiftright", n + F.call_function("shiftleft", F.lit(1).cast("long"), level * RUN_BITS) - 1, level * RUN_BITS)


def height(n: Column) -> Column:
    """The level of the top of a tree with n leaves."""
    return sum((F.when(n > (1 << (RUN_BITS * k)), 1).otherwise(0) for k in range(1, LEVELS)), F.when(n > 1, 1).otherwise(0))


def levels_below(h: Column) -> Column:
    """0 to h - 1."""
    return F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: k < h)


def _runs(nodes: Column) -> Column:
    """The nodes above an array of nodes that starts a run."""
    firsts = F.filter(F.transform(nodes, lambda _, i: i), lambda i: i % 8 == 0)
    return F.transform(firsts, lambda i: digest(F.array_join(F.transform(F.slice(nodes, i + 1, 8), hexed), "")))


def node_table(leaves: DataFrame, tallest: int) -> list[DataFrame]:
    """The nodes of all trees over ``leaves`` (tree, h, place, digest): one written table (tree, level, place, digest, h) for each pass of three levels."""
    current = leaves.select("tree", "place", "digest", "h").withColumn("level", F.lit(0))
    tables, base = [current], 0
    while base < tallest:
        live = current.where((F.col("level") == base) & (F.col("h") > base))
        packed = live.groupBy("tree", "h", F.expr("place div 512").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        packed = packed.withColumn("one", _runs(F.col("nodes.digest"))).withColumn("two", _runs(F.col("one"))).withColumn("three", _runs(F.col("two")))
        level = lambda c, k: F.transform(c, lambda d, i: F.struct(F.lit(base + k).alias("level"), (F.col("block") * (512 >> (3 * k)) + i).alias("place"), d.alias("digest")))  # noqa: B023, E731
        made = packed.select("tree", "h", F.explode(F.concat(level(F.col("one"), 1), level(F.col("two"), 2), level(F.col("three"), 3))).alias("x"))
        current = checkpoint(made.select("tree", "x.place", "x.digest", "h", "x.level").where("level <= h"))
        tables.append(current)
        base += 3
    return tables


def coordinates() -> Column:
    """The siblings of (place, n, h): array of (level, place), lowest level first."""
    place, n = F.col("place"), F.col("n")

    def on(level: Column) -> Column:
        mine = F.call_function("shiftright", place, level * RUN_BITS)
        first = mine - mine % 8
        run = F.sequence(first, F.least(first + 7, size_at(n, level) - 1))
        return F.transform(F.filter(run, lambda j: j != mine), lambda j: F.struct(level.alias("level"), j.alias("place")))

    return F.flatten(F.transform(levels_below(F.col("h")), on))


def _siblings(leaves: DataFrame, tables: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Rows (tree, place, siblings): for each leaf that has siblings, array of (level, place, digest) in order. ``sizes``: nodes a level."""
    mine = leaves.select("tree", F.col("place").alias("leaf"), F.explode(coordinates()).alias("x")).select("tree", "leaf", "x.level", "x.place")
    nodes = tables[0].select(*_NODE)
    for t in tables[1:]:
        nodes = nodes.unionByName(t.select(*_NODE))
    small = next((k for k in range(len(sizes)) if sum(sizes[k:]) <= BROADCAST_ROWS), len(sizes))
    on = ["tree", "level", "place"]
    low = mine.where(F.col("level") < small).join(nodes.where(F.col("level") < small), on)
    high = mine.where(F.col("level") >= small).join(F.broadcast(nodes.where(F.col("level") >= small)), on)
    found = (low.unionByName(high) if small else high).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("level", "place", "digest"))).alias("siblings"))
    return found.withColumnRenamed("leaf", "place")


def prove(leaves: DataFrame, tallest: int, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (tree, place, n, h, digest, ...) with their ``siblings``, and the top of every tree (tree, digest)."""
    tables = node_table(leaves, tallest)
    tops = [t.where("level = h").select("tree", "digest") for t in tables]
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    found = leaves.join(_siblings(leaves, tables, sizes), ["tree", "place"], "left")
    none = F.array().cast("array<struct<level:int,place:bigint,digest:binary>>")
    return found.withColumn("siblings", F.coalesce("siblings", none)), checkpoint(top)


def proof(siblings: Column) -> Column:
    """A proof's digests as text, in order."""
    return F.array_join(F.transform(siblings, lambda s: hexed(s["digest"])), "")


def fold(digest_: Column, place: Column, h: Column, siblings: Column) -> Column:
    """The top that a leaf, its place in a tree of height ``h`` and its siblings give."""

    def step(own: Column, level: Column) -> Column:
        mine = F.call_function("shiftright", place, level * RUN_BITS)
        side = lambda keep: F.array_join(F.transform(F.filter(siblings, lambda s: (s["level"] == level) & keep(s["place"])), lambda s: hexed(s["digest"])), "")
        return digest(F.concat(side(lambda j: j < mine), hexed(own), side(lambda j: j > mine)))

    return F.aggregate(levels_below(h), digest_, step)


def sizes_of(groups: DataFrame) -> tuple[int, list[int]]:
    """The greatest height of trees (n, h), and the nodes of all of them on each level that has siblings."""
    counts = [F.sum(F.when(F.col("h") > k, size_at(F.col("n"), k)).otherwise(0)).alias(f"l{k}") for k in range(LEVELS)]
    row = groups.agg(F.max("h").alias("h"), *counts).first()
    return row["h"], [int(row[f"l{k}"]) for k in range(row["h"])]


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", tampered: Column | None = None) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof, folded_root, verified), digests as hex and ``proof`` the siblings' digests in order.

    ``tampered`` says which rows are folded from their tampered leaf (their text lower-cased) instead of their own.
    """
    own = leaf([F.col(f) for f in fields])
    wrong = leaf([lowered(F.col(f)) if f == text else F.col(f) for f in fields])
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(group).alias("grp"), own.alias("digest"), F.when(hit, wrong).alias("other"))
    rows, total, _ = ordered(rows, [F.col("grp"), F.col("doc_id"), F.col("digest")])
    kind = docs.schema[id].dataType.simpleString()
    if not total:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    groups = checkpoint(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("base")).withColumn("h", height(F.col("n"))))
    groups, trees, _ = ordered(groups, [F.col("grp")])
    groups = groups.select("grp", "n", "h", "base", F.col("_pos").alias("tree"))
    held = groups.withColumnsRenamed({"grp": "g"})
    leaves = rows.join(bounded(held, "g"), F.col("grp").eqNullSafe(F.col("g"))).select("doc_id", "tree", (F.col("_pos") - F.col("base")).alias("place"), "n", "h", "digest", "other")
    leaves, subroots = prove(leaves, *sizes_of(groups))
    above, root, up = upper(subroots, trees)
    above = above.withColumnRenamed("digest", "subroot")
    out = leaves.join(F.broadcast(above) if trees <= BROADCAST_GROUPS else above, "tree")
    folded = fold(F.coalesce("other", "digest"), F.col("place"), F.col("h"), F.col("siblings"))
    out = out.withColumn("lower", folded).withColumn("folded", fold(F.col("lower"), F.col("tree"), F.lit(up), F.col("upper")))
    return out.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
        F.concat(proof(F.col("siblings")), proof(F.col("upper"))).alias("proof"), hexed(F.col("folded")).alias("folded_root"), (hexed(F.col("folded")) == root).alias("verified"),
    )


def upper(subroots: DataFrame, trees: int) -> tuple[DataFrame, str, int]:
    """The tree over the groups' tops: rows (tree, digest, upper), its siblings a group; the root in hex; its height."""
    h, sizes, left = 0, [], trees
    while left > 1:
        sizes.append(left)
        h, left = h + 1, -(-left // 8)
    leaves = subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), F.lit(h).alias("h"), "digest")
    proved, top = prove(leaves, h, sizes)
    root = top.select(hexed(F.col("digest"))).first()[0]
    return proved.select(F.col("place").alias("tree"), "digest", F.col("siblings").alias("upper")), root, h
