"""BPE encoding and decoding: speculate and verify.

A word's tokens are first proposed by greedy longest match: a vectorised walk down the trie of the
tokens from every symbol of all new words at once, then jumps from each match to the next. A
proposal is right exactly if every token encodes to itself and every adjacent pair is compatible,
that is, if merging by rank would never join symbols across the pair's boundary. Pairs of all new
words are tested together: a vectorised walk goes back in time along the right edge of the left
token and the left edge of the right token and looks each meeting pair up among the merges. Only
words with a failing pair are merged exactly, in rounds that make one merge in each of them; very
long ones one by one with a heap. Results of distinct words are kept in a bounded cache per worker.

Defined results: a null text counts as empty and gives no tokens; strings of the vocabulary's added
tokens inside a text become those tokens; very long words are handled whole; equal rows are encoded
alike; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, small_batches

#: Distinct words whose encoding a worker keeps at once; beyond it the cache starts anew.
CACHE_WORDS = 200_000
#: Failing words of more symbols than this are merged one by one: rounds over a word cost the square of its length.
ROUND_SYMBOLS = 64
_NEVER = np.int64(1) << np.int64(60)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a tokenizer file, read once on the driver."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = np.array([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.names = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        self._encoder: Encoder | None = None

    def __getstate__(self):
        return self.__dict__ | {"_encoder": None}

    @property
    def encoder(self) -> Encoder:
        """The encoder of this vocabulary, made once in a process; a worker keeps it for all its tasks."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """The tokens of each ids joined by single spaces, as a vocabulary without a decoder reads."""
        ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
        tokens = self.names.take(pa.array(np.frombuffer(b"".join([x or b"" for x in ids]), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens), " ")


class Encoder:
    """Encodes words and texts with a Vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, n = v, max(v.tokens) + 1
        self.size = n
        self.left, self.right, self.born = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        rank = np.arange(len(v.merges), dtype=np.int64)
        made = v.merges[:, 2]
        self.left[made[::-1]], self.right[made[::-1]], self.born[made[::-1]] = v.merges[::-1, 0], v.merges[::-1, 1], rank[::-1]
        keys = v.merges[:, 0] * n + v.merges[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order], made
        self.by_pair = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(v.merges.tolist())))}
        symbols = byte_symbols()
        self.inner, self.final = (np.array([v.ids[c + end] for c in symbols], np.int64) for end in ("", v.suffix))
        self.grow()
        self.words = regex.compile(v.pattern)
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(v.added, key=len, reverse=True))) if v.added else None
        whole = np.flatnonzero(self.left >= 0)
        self.sound = np.ones(n, bool)  # tokens that encode to themselves
        for _ in range(64):
            good = self.compatible(self.left[whole], self.right[whole], self.born[whole])
            good &= self.sound[self.left[whole]] & self.sound[self.right[whole]]
            if (self.sound[whole] == good).all():
                break
            self.sound[whole] = good
        self.cache: dict[str, bytes] = {}

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each a with its b, ``_NEVER`` if they do not merge."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the boundary between tokens a and b survives merging by rank (below rank ``before``)."""
        a, b = a.copy(), b.copy()
        # a's edge is merged away at rank until_a, b's after rank until_b: equal ranks merge leftmost first
        until_a = np.full(len(a), _NEVER) if before is None else before.copy()
        until_b = until_a - 1
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self.ranked(x, y)
            crossed = (m < until_a[live]) & (m <= until_b[live])
            crossed &= m > np.maximum(self.born[x], self.born[y])
            ok[live[crossed]] = False
            live = live[~crossed & ((self.left[x] >= 0) | (self.left[y] >= 0))]
            x, y = a[live], b[live]
            back_b = self.born[y] >= self.born[x]  # undo what was merged last
            i, j = live[~back_b], live[back_b]
            until_a[i], a[i] = self.born[a[i]], self.right[a[i]]
            until_b[j], b[j] = self.born[b[j]], self.left[b[j]]
        return ok

    def grow(self) -> None:
        """The trie of the tokens over first symbols; node 0 is the root."""
        spelt = {i: (i,) for i in {*self.inner.tolist(), *self.final.tolist()}}
        for a, b, c in self.v.merges.tolist():
            spelt.setdefault(c, spelt[a] + spelt[b])
        child: dict[int, int] = {}
        ends = {}
        for i, path in spelt.items():
            node = 0
            for x in path:
                node = child.setdefault(node * self.size + x, len(child) + 1)
            ends[node] = i
        keys, nodes = np.array(list(child), np.int64), np.array(list(child.values()), np.int64)
        order = np.argsort(keys)
        self.steps, self.nodes = keys[order], nodes[order]
        self.ends = np.full(len(child) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all words, and how many each has: its bytes, the last with the end-of-word suffix."""
        raw = [w.encode("utf-8", "replace") for w in words]
        count = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, last = self.inner[flat], np.cumsum(count) - 1
        symbols[last] = self.final[flat[last]]
        return symbols, count

    def propose(self, symbols: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over the vocabulary: the tokens of all words and the word of each."""
        stop = np.repeat(np.cumsum(count), count)
        token, length = symbols.copy(), np.ones(len(symbols), np.int64)
        live, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(live):
            key = node * self.size + symbols[live + depth]
            at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit, depth = self.steps[at] == key, depth + 1
            live, node = live[hit], self.nodes[at[hit]]
            whole = self.ends[node] >= 0
            token[live[whole]], length[live[whole]] = self.ends[node[whole]], depth
            inside = live + depth < stop[live]
            live, node = live[inside], node[inside]
        begins, at = np.zeros(len(symbols), bool), np.cumsum(count) - count
        while len(at):
            begins[at] = True
            end = stop[at]
            at = at + length[at]
            at = at[at < end]
        return token[begins], np.repeat(np.arange(len(count)), count)[begins]

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words together: a round makes the lowest-ranked, leftmost merge of each."""
        t, count = self.spell(words)
        owner = np.repeat(np.arange(len(words)), count)

        def rank(i: np.ndarray) -> np.ndarray:  # of the pairs that begin at i
            j = np.minimum(i + 1, len(t) - 1)
            return np.where((j > i) & (owner[j] == owner[i]), self.ranked(t[i], t[j]), _NEVER)

        ranks = rank(np.arange(len(t)))
        while True:
            first = np.cumsum(count) - count
            low = np.minimum.reduceat(ranks, first)
            some = np.flatnonzero(low < _NEVER)
            if not len(some):
                return t, count
            # the leftmost place of the lowest rank, in words with any
            places = np.flatnonzero((ranks == np.repeat(low, count)) & (ranks < _NEVER))
            at = places[np.diff(owner[places], prepend=-1) > 0]
            t[at] = self.made[ranks[at]]
            keep = np.ones(len(t), bool)
            keep[at + 1] = False
            t, owner, ranks = t[keep], owner[keep], ranks[keep]
            count[some] -= 1
            at = at - np.arange(len(at))  # one symbol less for each word before
            ranks[at] = rank(at)
            at = at[at > 0] - 1
            ranks[at] = rank(at)

    def merge(self, word: str) -> list[int]:
        """Exact merging by rank, leftmost first, with a heap over a linked list."""
        t = self.spell([word])[0].tolist()
        n = len(t)
        after, prior = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.by_pair[p][0], i, *p) for i, p in enumerate(zip(t, t[1:])) if p in self.by_pair]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if t[i] != x or j < 0 or t[j] != y:
                continue
            t[i], t[j], after[i] = self.by_pair[x, y][1], -1, after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            for k in (prior[i], i):
                if k >= 0 and after[k] >= 0 and (p := (t[k], t[after[k]])) in self.by_pair:
                    heapq.heappush(heap, (self.by_pair[p][0], k, *p))
        return [x for x in t if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode new words into the cache: propose all, verify all pairs at once, merge what fails."""
        words = list(words)
        symbols, size = self.spell(words)
        flat, owner = self.propose(symbols, size)
        bad = np.zeros(len(words), bool)
        bad[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[inside[~good[back]]]] = True
        self.keep(words, flat, np.bincount(owner, minlength=len(words)))
        if few := [words[k] for k in np.flatnonzero(bad & (size <= ROUND_SYMBOLS))]:
            self.keep(few, *self.merge_all(few))
        for k in np.flatnonzero(bad & (size > ROUND_SYMBOLS)):
            self.cache[words[k]] = np.array(self.merge(words[k]), "<u4").tobytes()

    def keep(self, words: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        """Put words into the cache, whose tokens are the next ``count`` of ``flat``."""
        ids, end = flat.astype("<u4").tobytes(), 4 * np.cumsum(count)
        self.cache.update((w, ids[a:b]) for w, a, b in zip(words, (end - 4 * count).tolist(), end.tolist()))

    def normal(self, text: str) -> str:
        # lower-cased one character at a time: no final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list:
        """The words of a text in order; an added token in it is its id."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(self.normal(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.words.findall(self.normal(text[at : m.start()]))
            out.append(self.v.added[m.group()])
            at = m.end()
        return out + self.words.findall(self.normal(text[at:]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        new = {w for s in split for w in s}.difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = {w for s in split for w in s}
        added = {w for w in new if isinstance(w, int)}
        self.cache.update((i, np.array([i], "<u4").tobytes()) for i in added)
        if new - added:
            self.learn(new - added)
        get = self.cache.__getitem__
        return [b"".join(map(get, s)) for s in split]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Replace column ``text`` by ``out``: the ids as binary, 4 little-endian bytes each."""
    keep = tuple(c for c in docs.columns if c not in (text, out))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file, of fixed size
    return map_texts(docs, text, keep, [T.StructField(out, T.BinaryType())], lambda texts: [shared.value.encoder.encode(texts)])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``: the texts that ``ids`` decode to."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield shared.value.decode(b.to_pylist())

    return encoded.withColumn(out, F.arrow_udf(run, T.StringType())(F.col(ids)))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace column ``text`` by ``ids`` and ``out``: encoded, and decoded from those ids, in one pass."""
    keep = tuple(c for c in docs.columns if c not in (text, ids, out))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def both(texts: list) -> list:
        coder = shared.value
        found = coder.encoder.encode(texts)
        return [found, coder.decode(found)]

    return map_texts(docs, text, keep, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())], both)
