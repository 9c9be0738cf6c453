"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from labelled texts (log-odds less two standard
errors), on top of a few fixed insults. Dense features of a whole text are lexicon densities, lexicon
hits near second-person words, capitals, punctuation and obfuscation rates. Trees are fitted on
features whose lexicon comes from the other half of the rows, so that a row's own words do not
speak for it; pool-adjacent-violators on cross-fitted margins turns margins into probabilities.

The lexicon and the trees are fitted on a bounded sample of labelled rows; scoring covers all rows and
whole texts.

Defined results: null and empty texts are scored like a text without words; equal texts get equal
scores; rows without a label are not learned from; with one class or no labelled row every score is the
share of label 1 (0 without rows); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_texts, release

#: About so many labelled rows fit the model; the lexicon keeps so many terms.
SAMPLE_ROWS, LEXICON_TERMS = 12_000, 2_000
#: Insults known beforehand, and words that address a reader.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile cretin bastard bitch asshole fuck fucking shit retard whore slut scumbag jerk dickhead arschloch idiotisch dumm connard salope merde imbécile estúpido idiota pendejo cabrón mierda".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
STRONG, WEAK, KNOWN = 2.0, 1.0, 4.0
FEATURES = ("words", "strong_density", "strong_hits", "weak_density", "strongest", "near_second", "capitals", "capital_words", "exclamations", "questions", "punctuation", "obfuscated", "obfuscated_hits", "stretched", "distinct_hits")

_WORD = re.compile(r"[^\W\d_]+")
#: Character classes, bits of a table over the code points.
LETTER, WORDLY, SPACE, RAISED, CAPITAL, MASK = 1, 2, 4, 8, 16, 32
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None})


def terms(text: str) -> set[str]:
    """The distinct lexicon terms of a text: whole words (marked by $) and beginnings of 3 to 8 letters."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] for k in range(3, min(len(w), 8) + 1))
    return out


def weigh(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Smoothed log-odds of a term in texts of label 1, less two standard errors."""
    odds = lambda a, n: math.log((a + 0.5) / (n - a + 0.5))
    return odds(pos, n_pos) - odds(neg, n_neg) - 2 * math.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


class Lexicon(dict):
    """Weights of words: a word weighs as much as its heaviest term. Weights found are kept, in bounded number."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.heads = {t[:3] for t in weights} | {w[:3] for w in INSULTS}

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def __missing__(self, w: str) -> float:
        found = 0.0
        if (w + "$")[:3] in self.heads:  # else no term begins like this word
            get = self.weights.get
            found = max([KNOWN if w in INSULTS else 0.0, get(w + "$", 0.0), *(get(w[:k], 0.0) for k in range(3, min(len(w), 8) + 1))])
        if len(self) > 100_000:
            self.clear()
        if len(w) < 64:
            self[w] = found
        return found

    def masked(self, word: str) -> bool:
        """Whether an obfuscated word, spelled plainly, is a strong one."""
        plain = word.lower().translate(_PLAIN)
        return self[plain] >= STRONG or self[plain.replace("i", "l")] >= STRONG


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class bits of every code point of the basic plane; the last entry stands for those beyond it."""
    out = np.zeros((1 << 16) + 1, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER | WORDLY | RAISED * (c.lower() != c) | CAPITAL * ("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×")
        elif c == "_" or c.isalnum():
            out[i] = WORDLY
        elif c.isspace():
            out[i] = SPACE
        if c in "0123456789@$*!|":
            out[i] |= MASK
    out[-1] = WORDLY
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line feed, and where each text starts."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4"), np.append(0, np.cumsum(size)[:-1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; the last flag is false."""
    change = np.flatnonzero(np.diff(flags, prepend=False))
    return change[::2], change[1::2]


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """The dense features of whole texts, a row each, in the order of FEATURES. Work is in proportion to the texts' length."""
    texts = [t or "" for t in texts]
    out = np.zeros((len(texts), len(FEATURES)))
    code, first = codes(texts)
    kind = classes()[np.minimum(code, 1 << 16)]
    per = lambda flags: np.add.reduceat(flags, first, dtype=np.int64)
    count = lambda at: np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(texts))
    size = np.maximum(np.array([len(t) for t in texts]), 1)
    raised, exclaims, questions = per(kind & RAISED > 0), per(code == 33), per(code == 63)
    punct = per((kind & (WORDLY | SPACE)) == 0)
    a, b = runs(kind & WORDLY > 0)
    capital = np.append(0, np.cumsum(kind & CAPITAL > 0))
    shouted = count(a[(b - a >= 2) & (capital[b] - capital[a] == b - a)])
    # obfuscated: a run of letters, digits and masks in which masks stand between two letters
    letter, mask = kind & LETTER > 0, kind & MASK > 0
    a, b = runs(mask)
    inner = a[(a > 0) & letter[a - 1] & letter[b]]
    a, b = runs(mask | (kind & WORDLY > 0) & (code != 95))
    hidden = np.unique(np.searchsorted(a, inner, side="right") - 1)
    masked, caught = count(a[hidden]), np.zeros(len(texts))
    for k in hidden.tolist():
        i = int(np.searchsorted(first, a[k], side="right")) - 1
        caught[i] += lexicon.masked(texts[i][a[k] - first[i] : b[k] - first[i]])
    low = [t.lower() for t in texts]
    code, first = codes(low)
    same = np.append(code[1:] == code[:-1], False) & (classes()[np.minimum(code, 1 << 16)] & LETTER > 0)
    a, b = runs(same)
    stretched = np.zeros(len(texts), np.int64)
    np.add.at(stretched, np.searchsorted(first, a, side="right") - 1, (b - a + 1) // 3)
    weigh_ = lexicon.__getitem__
    for i, t in enumerate(low):
        words = _WORD.findall(t)
        z = np.fromiter(map(weigh_, words), np.float64, len(words))
        strong = np.flatnonzero(z >= STRONG).tolist()
        n = max(len(words), 1)
        near = sum(1 for k in strong if not SECOND.isdisjoint(words[max(0, k - 5) : k + 6]))
        out[i] = (
            math.log1p(len(words)),
            100 * z[strong].sum() / n,
            math.log1p(len(strong)),
            100 * np.count_nonzero((z >= WEAK) & (z < STRONG)) / n,
            z.max(initial=0.0),
            math.log1p(near),
            raised[i] / size[i],
            shouted[i] / n,
            100 * exclaims[i] / n,
            100 * questions[i] / n,
            punct[i] / size[i],
            100 * masked[i] / n,
            math.log1p(caught[i]),
            100 * stretched[i] / n,
            math.log1p(len({words[k] for k in strong})),
        )
    return out


class Trees:
    """Boosted regression trees on the logistic loss, grown on histograms of quantile bins."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        width, cols = self.bins, x.shape[1]
        flat = b + np.arange(cols) * width
        margin, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            inner = (1 << self.depth) - 1
            column, split, leaf = np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner + 1 + inner)
            node = np.zeros(len(y), np.int64)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                if len(rows) < 2 * self.least:
                    continue
                f = flat[rows].ravel()
                sums = lambda v: np.bincount(f, np.repeat(v[rows], cols), minlength=width * cols).reshape(cols, width).cumsum(1)
                gl, hl, nl = sums(g), sums(h), sums(np.ones(len(y)))
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(nl < self.least) | (nt - nl < self.least)] = -1
                c, s = np.unravel_index(gain.argmax(), gain.shape)
                if gain[c, s] > 1e-6:
                    column[at], split[at] = c, s
                    node[rows] = 2 * at + 1 + (b[rows, c] > s)
            for k in np.unique(node):
                rows = node == k
                leaf[k] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            margin += leaf[node]
            self.trees.append((column, split, leaf))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], axis=1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for column, split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inside = node < len(column)
                at = np.where(inside, node, 0)
                go = inside & (column[at] >= 0)
                node = np.where(go, 2 * node + 1 + (b[rows, column[at]] > split[at]), node)
            out += leaf[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of a rising function."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean of y, weight, sum of margins
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, m2 = blocks.pop()
            v1, w1, m1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, m1 + m2]
    return np.array([m / w for _, w, m in blocks]), np.array([v for v, _, _ in blocks])


class Model:
    """Lexicon, trees and calibration; ``constant`` where nothing could be learned."""

    def __init__(self, lexicon: Lexicon | None = None, trees: Trees | None = None, knots=None, constant: float = 0.0):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        m = self.trees.margin(features(texts, self.lexicon))
        # a trace of the margin itself keeps the order inside the flat parts of the calibration
        return 0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``sample`` labelled rows where ``may_learn`` (over the id) holds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).where(may_learn).groupBy(id).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if not n:
        return Model()
    draw = F.pmod(F.xxhash64(F.lit(5), F.col(id)), F.lit(1 << 30))
    picked = checkpoint(known.where(draw < F.lit(int(min(1.0, sample / n) * (1 << 30)))))
    if (got := picked.count()) > 2 * sample + 1000:  # cannot happen by chance
        raise ValueError(f"{got} rows picked for a sample of {sample}")
    rows = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), id)  # at most 2 * sample small rows
    rows = checkpoint(rows.select(F.col(id).alias("id"), "text", "y", F.pmod(F.xxhash64(F.lit(6), F.col(id)), F.lit(2)).cast("int").alias("fold")))

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t, y, fold in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                seen.update((x, fold, y) for x in terms(t))
        kept = list(seen.items())
        for at in range(0, len(kept), 100_000):
            part = kept[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in part]), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.int32()), pa.array([v for _, v in part], pa.int64())], names=["term", "fold", "y", "n"])

    size = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    many = lambda fold, y: sum(v for (f, k), v in size.items() if k == y and fold in (None, f))
    total, ones = sum(size.values()), many(None, 1)
    if not total or not ones or ones == total:
        return Model(constant=ones / total if total else 0.0)
    sums = lambda fold, y: F.sum(F.when((F.col("y") == y) & (F.col("fold") == fold), F.col("n")).otherwise(0))
    table = rows.mapInArrow(count, "term string, fold int, y int, n long").groupBy("term").agg(*[sums(f, y).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)])
    # only terms of several toxic texts can pass; the lexicon itself is bounded
    strong = table.where("n01 + n11 >= 3").where(f"(n01 + n11) / {ones} > 2 * (n00 + n10) / {max(total - ones, 1)}")
    strong = strong.orderBy(F.desc(F.expr("(n01 + n11 + 0.5) / (n00 + n10 + 0.5) * ln(1.0 + n01 + n11)")), "term").limit(4 * LEXICON_TERMS).collect()

    def lexicon(fold: int | None) -> Lexicon:
        w = {}
        for r in strong:
            pos, neg = (sum(r[f"n{f}{y}"] for f in (0, 1) if fold in (None, f)) for y in (1, 0))
            if pos >= 3 and (z := weigh(pos, neg, many(fold, 1), many(fold, 0))) >= WEAK:
                w[r["term"]] = z
        return Lexicon(dict(sorted(w.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_TERMS]))

    halves, whole = [lexicon(0), lexicon(1)], lexicon(None)
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def measure(batches):
        for b in batches:
            texts, folds = b.column(1).to_pylist(), b.column(3).to_pylist()
            x = [features([t], shared.value[1 - f])[0].tobytes() for t, f in zip(texts, folds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.binary())], names=["id", "y", "fold", "x"])

    got = sorted(rows.mapInArrow(measure, "id long, y int, fold int, x binary").collect())  # the bounded sample
    x, y, fold = np.array([np.frombuffer(r["x"]) for r in got]), np.array([r["y"] for r in got]), np.array([r["fold"] for r in got])
    margin = np.zeros(len(y))
    for k in (0, 1):
        learn, rest = fold != k, fold == k
        if rest.any():
            margin[rest] = Trees().fit(x[learn], y[learn]).margin(x[rest]) if learn.any() else 0.0
    model = Model(whole, Trees().fit(x, y), isotonic(margin, y))
    del got, strong
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Model | Broadcast, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Columns ``keep`` and ``name``, the score (0 to 1), of every row."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, text, keep, [T.StructField(name, T.DoubleType())], lambda texts: [shared.value.score(texts)])
