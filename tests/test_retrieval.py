"""Bounded retrieval against the full join, and how much of the postings it reads."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glossweave.operators import retrieval

STOP = {"the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "well"}


def tokens(text):
    return {w.lower() for w in re.split("[^A-Za-z']+", text or "") if len(w) > 2} - STOP


def brute(queries, entries, limit=500, share=0.4, extra=lambda q, e: 0.0):
    """{(query, id): score} of what is within ``share`` of a query's best; rows are (id, text, ...)."""
    n, df = len(entries), Counter(t for e in entries for t in tokens(e[1]))
    idf = lambda t: math.log(n / (df[t] + 1)) + 1
    norm = lambda ts: math.sqrt(sum(idf(t) ** 2 for t in ts))
    out = {}
    for q in queries:
        mine, scores = tokens(q[1]), {}
        for e in entries:
            both = mine & tokens(e[1])
            if both and len(e[1]) <= limit:
                scores[e[0]] = sum(idf(t) ** 2 for t in both) / (norm(mine) * norm(tokens(e[1]))) + extra(q, e)
        best = max(scores.values(), default=0)
        out |= {(q[0], i): s for i, s in scores.items() if s >= share * best}
    return out


def corpus(rng, n, first=0):
    """Texts of rare words, with a few that nearly every text has, some very short, some long."""
    rare, common = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], ["iron", "sword", "old", "great"]
    rows = []
    for i in range(first, first + n):
        k = rng.choice([1, 2, 3, 5, 8, 20])
        text = " ".join(rng.choices(rare, k=k) + [c for c in common if rng.random() < 0.8])
        rows.append((i, text * (12 if rng.random() < 0.05 else 1), f"p{rng.randrange(3)}"))
    return rows


@pytest.mark.parametrize("boosted", [False, True])
def test_equals_the_full_join(spark, boosted):
    rng = random.Random(11)
    entries = corpus(rng, 250) + [(900, None, "p0"), (901, "", "p0"), (902, "iron", "p1"), (903, "iron sword old great", "p2")]
    queries = corpus(rng, 60, 2000) + entries[:40] + [(3000, "zzz unknown iron", "p0"), (3001, None, "p1"), (3002, "unknown", "p1")]
    schema = "id long, text string, plugin string"
    extra = retrieval.bonus(F.col("q_plugin") == F.col("e_plugin"), F.lit("A FULL"), F.lit("A DESC")) if boosted else None
    got = retrieval.similar(spark.createDataFrame(queries, schema), spark.createDataFrame(entries, schema), "id", "text", "id", "text", extra=extra, most=0.08 if boosted else 0.0, more=("plugin",))
    got = {(r["query"], r.id): r.score for r in got.collect()}
    filled = [(i, t or "", p) for i, t, p in entries]
    want = brute([(i, t or "", p) for i, t, p in queries], filled, extra=lambda q, e: (0.06 if q[2] == e[2] else 0.0) + 0.02 if boosted else 0.0)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_scopes_are_apart(spark):
    rng = random.Random(3)
    done, open_ = corpus(rng, 90), corpus(rng, 40, 500)
    schema = "id long, text string, plugin string"
    got = retrieval.same_mod_hints(spark.createDataFrame(open_, schema), spark.createDataFrame(done, schema), "id", "text", "plugin", 10)
    got = {(r.plugin, r.id): (r.score, r["rank"]) for r in got.collect()}
    want = {}
    for p in ("p0", "p1", "p2"):
        best = defaultdict(float)
        for (_, i), s in brute([q for q in open_ if q[2] == p], [e for e in done if e[2] == p], share=0).items():
            best[i] = max(best[i], s)
        top = max(best.values())
        kept = sorted((round(-s, 9), i) for i, s in best.items() if s >= 0.4 * top)[:10]
        want |= {(p, i): (-s, k) for k, (s, i) in enumerate(kept, 1)}
    assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-8 and got[k][1] == want[k][1] for k in want)


def test_frequent_tokens_are_not_read(spark):
    """Near copies among many texts that share frequent words: a small part of the postings is read."""
    rng = random.Random(5)
    word = lambda c, i: c + "".join(chr(97 + int(d)) for d in str(i)) + "x"
    entries = [(i, " ".join([word("x", i), word("z", i), word("u", i // 2), *rng.choices([word("m", k) for k in range(40)], k=4), "iron", "sword"])) for i in range(600)]
    rows = spark.createDataFrame(entries, "id long, text string")
    idf = retrieval.index(rows, "id", "text")[2]
    sizes = rows.agg(F.lit("").alias("scope"), F.count(F.lit(1)).alias("n"))
    v = retrieval.vectors(rows, "id", "text", idf, sizes)
    read = retrieval.candidates(v, v).agg(F.sum("read")).first()[0]
    df = Counter(t for _, text in entries for t in tokens(text))
    every = sum(n * n for n in df.values())
    assert 600 <= read < 0.02 * every
    assert df["iron"] == 600 and read < 600 * 30


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, plugin string")
    some = spark.createDataFrame([(1, "iron", "p")], none.schema)
    for q, e in ((none, none), (some, none), (none, some)):
        assert retrieval.similar(q, e, "id", "text", "id", "text").count() == 0
        assert retrieval.same_mod_hints(q, e, "id", "text", "plugin", 5).count() == 0
