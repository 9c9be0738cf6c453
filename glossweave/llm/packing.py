"""Best-fit packing of tokenised documents into sequences by a configuration linear program.

Only the histogram of piece lengths (at most as many rows as a sequence has tokens) reaches the driver. There the
configuration program, least total of configurations (multisets of lengths that fit a sequence) so that every length
is covered as often as it occurs, is solved by multiplicative weights: lengths that lag behind are dear, a knapsack
by dynamic programming prices the configurations, and all configurations that are nearly the dearest get a step. The
prices of every round also give a lower bound on the number of sequences. Half of the solution is taken, rounded down, and
what is left is solved again, a few times; the last pieces go where they fit best. Pieces, numbered within their length over a range-partitioned
order, look their sequence and place up in the plan, whose size depends on the sequence length alone.

Defined results: a null text is empty and one piece of one token (the end mark); longer documents than a sequence are cut into whole
sequences after a first piece with the rest; repeated rows and ids are packed once a row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import checkpoint, map_texts, ordered, small_batches

#: Tokens in a sequence, and the id that ends every document (fixed by the contract).
CAPACITY, END = 2048, 0
#: Rounds of pricing for a histogram; how near the dearest a configuration must be; greatest step of an update, as a share of a length's
#: count; updates of the weights a round.
ROUNDS, NEAR, STEP, TURNS = 25, 0.1, 0.2, 60
#: Times that the program is solved for what is left, and the share of a solution that is taken each time but the last.
PASSES, SHARE = 8, 0.5


class Coder:
    """Ids of texts by a byte-level BPE file of the tokenizers library. The file's vocabulary is also given to a faster encoder of
    ranks; a text with a character that the two would split differently, or that the faster one refuses, goes to the library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        self._state = None

    def __getstate__(self):
        return self.__dict__ | {"_state": None}

    def _load(self):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(self.spec)
        whole = Tokenizer.from_str(self.spec)
        whole.no_truncation()
        whole.no_padding()
        raw = {s: b for b, s in enumerate(byte_symbols())}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(raw[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self._state = whole, fast, regex.compile(pattern), {}

    def alike(self, c: str) -> bool:
        """Whether a character is of one class to both encoders: it is split alike beside letters, digits, marks and space."""
        whole, fast, _, known = self._state
        if c not in known:
            s = f"a{c}b {c}{c} 1{c}2, {c} {c}"
            known[c] = whole.encode(s, add_special_tokens=False).ids == fast.encode_ordinary(s)
        return known[c]

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._state is None:
            self._load()
        whole, fast, _, _ = self._state
        if text.isascii() or all(map(self.alike, set(text))):
            try:
                return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of white space too long for its pattern
                pass
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def piece_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """The pieces of a document of ``total`` tokens: whole sequences after a first one with the rest."""
    if total <= capacity:
        return [total]
    rest = total % capacity
    return ([rest] if rest else []) + [capacity] * (total // capacity)


def _cut(ids: bytes, capacity: int) -> list[bytes]:
    out, at = [], 0
    for n in piece_lengths(len(ids) // 4, capacity):
        out.append(ids[4 * at : 4 * (at + n)])
        at += n
    return out


def pieces(docs: DataFrame, coder: Coder, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), at least one a document."""
    shared, end = docs.sparkSession.sparkContext.broadcast(coder), np.array([END], "<u4").tobytes()

    def run(texts: list) -> list:
        cut = [_cut(shared.value.encode(t) + end, capacity) for t in texts]
        return [[[len(p) // 4 for p in c] for c in cut], [[zlib.crc32(p) for p in c] for c in cut]]

    many = T.ArrayType(T.LongType())
    found = map_texts(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")), "text", ("doc_id",), [T.StructField("lengths", many), T.StructField("crcs", many)], run)
    rows = found.select("doc_id", F.get("lengths", F.lit(0)).alias("first"), F.posexplode(F.arrays_zip("lengths", "crcs")).alias("piece", "x"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("first") + (F.col("piece") - 1) * capacity).cast("long")
    return rows.select("doc_id", "piece", start.alias("start"), F.col("x.lengths").alias("length"), F.col("x.crcs").alias("ids_crc32"))


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The dearest multiset of lengths for every room up to ``capacity``: its value, and the item put in last (-1: none, room left)."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        k = fits[room]
        value[room] = value[room - 1]
        if k:
            got = value[room - lengths[:k]] + price[:k]
            best = int(got.argmax())
            if got[best] > value[room]:
                value[room], last[room] = got[best], best
    return value, last


def _fill(lengths: np.ndarray, last: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """The items of the dearest configurations that hold each of ``first``, a row each (-1: none)."""
    below = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))  # the room down to where an item ends
    room, rows = capacity - lengths[first], [first]
    while True:
        room = below[room]
        item = last[room]
        if (item < 0).all():
            return np.stack(rows, 1)
        rows.append(item)
        room = np.where(item >= 0, room - lengths[item], 0)


class Columns:
    """Configurations as flat arrays: for each its items and their copies, sorted by configuration."""

    def __init__(self, items: int):
        self.items, self.known = items, {}
        self.row, self.own, self.copies = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, found: np.ndarray) -> None:
        """Add rows of item places (-1: none) that are not there yet."""
        new = [c for c in (tuple(i for i in held if i >= 0) for held in np.sort(found, 1).tolist()) if c not in self.known]
        for c in dict.fromkeys(new):
            self.known[c] = len(self.known)
            own, copies = np.unique(c, return_counts=True)
            self.row = np.concatenate([self.row, np.full(len(own), self.known[c])])
            self.own, self.copies = np.concatenate([self.own, own]), np.concatenate([self.copies, copies])


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """The configuration program by multiplicative weights: amounts of configurations (tuples of item places, rising) that cover
    the counts about once, and a lower bound on the number of sequences.

    A round prices by the knapsack and adds for each length the dearest configuration that holds it, if that is nearly the dearest of all; then the weights are updated
    ``TURNS`` times over the configurations known so far.
    """
    columns, bound = Columns(len(lengths)), counts @ lengths / capacity
    covered, amount = np.zeros(len(lengths)), np.zeros(0)
    for turn in range(rounds):
        step = max(STEP / (1 + turn / 8), STEP / 10)
        rate = 0.5 / step
        price = np.exp(-rate * (covered - covered.min())) / counts
        value, last = knapsack(lengths, price, capacity)
        bound = max(bound, counts @ price / value[-1])
        holds = price + value[capacity - lengths]
        near = NEAR if turn else 1.0
        columns.add(_fill(lengths, last, np.flatnonzero(holds >= (1 - near) * value[-1]), capacity))
        amount = np.concatenate([amount, np.zeros(len(columns.known) - len(amount))])
        row, own, copies = columns.row, columns.own, columns.copies
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        most = np.minimum.reduceat(counts[own] / copies, starts)
        for _ in range(TURNS):
            worth = np.add.reduceat(price[own] * copies, starts)
            weight = np.where(worth >= (1 - NEAR) * worth.max(), most, 0.0)
            use = np.bincount(own, weight[row] * copies, len(lengths)) / counts
            scale = step / use.max()
            amount += scale * weight
            covered += scale * use
            price = np.exp(-rate * (covered - covered.min())) / counts
    level = covered.mean()
    return {c: float(amount[k] / level) for c, k in columns.known.items() if amount[k] > 0}, float(bound)


def _best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Longest first, each into the fullest sequence with room: equal pieces and equal sequences are handled together."""
    free: dict[int, list[list]] = defaultdict(list)  # room: [contents, how many]
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in free if r >= size), default=capacity)
            if not free.get(room):
                free[room].append([(), -(-left // (capacity // size))])
            inside, many = free[room].pop()
            if not free[room]:
                del free[room]
            each = room // size
            full, rest = min(many, left // each), 0
            if full < many and left - full * each:
                rest = left - full * each
            part = 1 if rest else 0
            for n, copies in ((full, each), (part, rest), (many - full - part, 0)):
                if n:
                    free[room - copies * size].append([inside + (size,) * copies, n])
            left -= full * each + rest
    out = Counter()
    for groups in free.values():
        for inside, n in groups:
            out[tuple(sorted(inside, reverse=True))] += n
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Counter, float]:
    """How often each sequence content (lengths, longest first) is used, and the lower bound on their number."""
    left, out, bound = {k: n for k, n in histogram.items() if n}, Counter(), 0.0
    for turn in range(PASSES):
        share = SHARE if turn < PASSES - 1 else 1.0
        if not left:
            break
        lengths = np.array(sorted(left))
        amounts, least = configurations(lengths, np.array([left[k] for k in lengths.tolist()], float), capacity)
        bound = bound or least
        fill = lambda c: int(lengths[list(c)].sum())  # noqa: B023, E731
        used = 0
        for c in sorted(amounts, key=lambda c: (-fill(c), -amounts[c], c)):
            copies = Counter(lengths[list(c)].tolist())
            many = min([int(amounts[c] * share), *(left[k] // n for k, n in copies.items())])
            if many:
                out[tuple(sorted(lengths[list(c)].tolist(), reverse=True))] += many
                used += many
                for k, n in copies.items():
                    left[k] -= many * n
        left = {k: n for k, n in left.items() if n}
        if not used:
            break
    return out + _best_fit(left, capacity), bound


def slots(histogram: dict[int, int], contents: Counter) -> dict[str, np.ndarray]:
    """The plan as a table by pieces in order of length: entry i holds pieces from ``begin[i]``; its k-th goes to sequence
    ``sequence + k // copies``, at ``offset + k % copies * length``."""
    entries, number = defaultdict(list), 0
    for content, many in sorted(contents.items(), reverse=True):
        at = 0
        for size, copies in Counter(content).items():
            entries[size].append((many, number, copies, at))
            at += size * copies
        number += many
    rows, begin = [], 0
    for size in sorted(entries):
        for many, first, copies, at in entries[size]:
            rows.append((begin, first, copies, at, size))
            begin += many * copies
    names = "begin", "sequence", "copies", "offset", "length"
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with ``length``, at most ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = rows.sparkSession
    rows = checkpoint(rows).withColumn("_row", F.monotonically_increasing_id())  # fixed by the written rows
    histogram = {int(r["length"]): r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    if not histogram:
        return rows.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    contents, _ = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast(slots(histogram, contents))  # its size depends on the lengths, not on the documents
    placed, _, _ = ordered(rows, [F.col("length"), F.col("_row")])
    small_batches(spark)

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(pos: pa.Array) -> pa.Array:
        t, at = shared.value, pos.to_numpy(zero_copy_only=False)
        i = np.searchsorted(t["begin"], at, "right") - 1
        k = at - t["begin"][i]
        sequence, offset = t["sequence"][i] + k // t["copies"][i], t["offset"][i] + k % t["copies"][i] * t["length"][i]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = placed.withColumn("_at", place(F.col("_pos")))
    return placed.withColumns({"sequence_id": F.col("_at")["sequence_id"], "offset": F.col("_at")["offset"]}).drop("_at", "_row", "_pos", "_start")


def sequences(docs: DataFrame, placed: DataFrame, coder: Coder, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: (sequence_id, tokens, ids), ids as binary. Ids of documents must be unique for this."""
    shared, end = docs.sparkSession.sparkContext.broadcast(coder), np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([_cut(shared.value.encode(t) + end, capacity) for t in b.to_pylist()], pa.list_(pa.binary()))

    small_batches(docs.sparkSession)
    cut = F.arrow_udf(run, T.ArrayType(T.BinaryType()))
    parts = docs.select(F.col(id).alias("doc_id"), cut(F.col(text).cast("string")).alias("cut")).select("doc_id", F.posexplode("cut").alias("piece", "part"))
    found = placed.select("doc_id", "piece", "sequence_id", "offset").join(parts, ["doc_id", "piece"])
    held = found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))  # at most ``capacity`` tokens
    ids = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["part"]))
    return held.select("sequence_id", ids.alias("ids")).select("sequence_id", (F.octet_length("ids") / 4).cast("long").alias("tokens"), "ids")
