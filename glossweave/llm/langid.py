"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of the lower-cased text's letters, with every other run of characters
as one space; term frequencies are relative and weighted by inverse document frequency. The weights
are learned by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, then one
temperature is fitted on held-back rows so that scores are calibrated. Document frequencies cover all
rows that may be learned from; the weights are fitted on a bounded sample of them.

Because features are linear in the positions of a text, prediction sums one table row per position and
needs no sparse vectors; texts of any length are read whole.

Defined results: a null text or one without a letter is ``und`` with score 0; rows without a label or id are
not learned from but are predicted; equal texts get equal results; with nothing to learn from all
is ``und``; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped, map_texts, partitions, release

#: n-gram orders and the number of hashed features.
ORDERS, FEATURES = (1, 2, 3), 1 << 16
#: Document frequencies are added up in so many pieces.
PIECES = 64
#: At most so many labelled rows a language fit the weights (in expectation; chosen by hashed id).
SAMPLE_PER_LANGUAGE = 600
UNKNOWN = "und"

_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one row an order, one column a position, and where each text starts.

    Position i of a text stands for the n-grams that start there; n-grams do not cross texts. A gram that
    would run over the end is marked -1.
    """
    clean = [" " + _NOT_LETTER.sub(" ", t.lower()).strip() + " " for t in texts]
    size = np.array([len(c) for c in clean], np.int64)
    first = np.append(0, np.cumsum(size)[:-1])
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.empty((len(ORDERS), len(code)), np.int32)
    left = np.repeat(first + size, size) - np.arange(len(code))  # characters up to the text's end
    for row, n in enumerate(ORDERS):
        h = np.full(len(code), np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        for k in range(n):
            part = code[k:] if k else code
            h[: len(part)] = (h[: len(part)] ^ part) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        out[row] = (h >> np.uint32(16)).astype(np.int32) & (FEATURES - 1)
        out[row][left < n] = -1
    return out, first


class Model:
    """A fitted classifier: languages, one table row a feature (a weight each language, then the IDF), biases."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.languages, self.bias, self.temperature = languages, bias, temperature
        table = np.zeros((FEATURES + 1, len(languages) + 1), np.float32)  # the last row stands for no gram
        table[:-1, :-1], table[:-1, -1] = weights * idf[:, None], idf
        self.table = table

    def logits(self, texts: list[str]) -> np.ndarray:
        grams, first = buckets(texts)
        sums = np.zeros((len(texts), self.table.shape[1]))
        for row in grams:
            sums += np.add.reduceat(self.table[row], first, axis=0, dtype=np.float64)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each whole text and its calibrated probability."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            p = softmax(self.logits([texts[i] for i in known]) / self.temperature)
            for i, k, s in zip(known, p.argmax(1), p.max(1)):
                names[i], scores[i] = self.languages[k], float(s)
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net on sparse rows (indices, values); returns weights and bias."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i, v = rows[r]
            w = solve(z[i], n[i])
            p = v @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = v[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = solve(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda u: -np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(y)), y], 1e-12)).mean() + 1e-4 * u * u
    lo, hi, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, may_learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the rows where ``may_learn`` holds and ``lang`` is not null."""
    rows = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0))

    def frequencies(batches):
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in grouped(texts):
                grams, first = buckets(texts[lo:hi])
                n += hi - lo
                for part in np.split(grams, first[1:], axis=1):
                    seen = np.zeros(FEATURES + 1, bool)
                    seen[part.ravel()] = True
                    df += seen
        df[-1] = n
        parts = [x.astype("<i8").tobytes() for x in np.array_split(df, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], names=["piece", "df"])

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["piece", "df"])

    schema = "piece int, df binary"
    per = rows.select("text").mapInArrow(frequencies, schema).repartition(min(PIECES, partitions(docs.sparkSession)), "piece")
    df = np.concatenate([np.frombuffer(r["df"], "<i8") for r in sorted(per.mapInArrow(added, schema).collect())])  # one vector of fixed size
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(sample / n)).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < share * float(1 << 30))

    def features(batches):
        for b in batches:
            out = []
            texts = b.column(0).to_pylist()
            for t in texts:
                grams, _ = buckets([t])
                i, n = np.unique(grams[grams >= 0], return_counts=True)
                v = n * shared.value[i]
                out.append((i.astype("<i4").tobytes(), (v / max(v.sum(), 1e-9)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), b.column(2)], names=["lang", "i", "v", "id"])

    got = picked.select("text", "lang", "id").mapInArrow(features, "lang string, i binary, v binary, id long").collect()  # about `sample` rows a language
    got.sort(key=lambda r: (r["id"], r["lang"], r["i"], r["v"]))
    # weights are learned on unit-scale inputs, so that steps do not depend on text length
    scale = 30.0
    x = [(np.append(np.frombuffer(r["i"], "<i4"), np.int32(FEATURES)), np.append(np.frombuffer(r["v"], "<f4") * np.float32(scale), np.float32(1))) for r in got]
    y = np.array([languages.index(r["lang"]) for r in got])
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    weights, bias = ftrl([x[k] for k in train], y[train], len(languages))
    full = np.vstack([weights, bias])
    logits = np.array([v @ full[i] for i, v in (x[k] for k in np.flatnonzero(held))]).reshape(-1, len(languages))
    del x, got
    release(docs.sparkSession)
    return Model(languages, idf, weights * scale, bias, temperature(logits, y[held]))


def identify(docs: DataFrame, model: Model | Broadcast, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` and, as ``names``, the language and its probability, of every row."""
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return map_texts(docs, text, keep, fields, lambda texts: shared.value.predict(texts))
