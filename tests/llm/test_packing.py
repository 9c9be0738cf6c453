import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossweave.llm import common, packing
from glossweave.llm.queries import op13_packing

from .helpers import DATA, odd_documents

FILE = path("byte_bpe_50k.json")


def library_ids(texts):
    t = Tokenizer.from_file(FILE)
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def whole(contents):
    out = Counter()
    for content, n in contents.items():
        assert n > 0 and sum(content) <= 2048
        for size in content:
            out[size] += n
    return out


def check(rows, ids):
    """Every id of every document once, pieces as the contract cuts them, sequences gapless and within bounds."""
    placed, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(ids)
    for i, mine in pieces.items():
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.length for r in mine] == packing.piece_lengths(len(ids[i]))
        at = 0
        for r in mine:
            part = ids[i][at : at + r.length]
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(ids[i])
    for s in placed.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return len(placed)


def test_coder_equals_the_library():
    rng = random.Random(5)
    texts = ["", "a", " ", "<|endoftext|> x <|endoftext|>", "it's we'll 'S  \n\n x\t y", " " * 300_000 + "x", "ab" * 200_000, "՘࢏₏ aₐb", "ᲀ \U0001f600‍\x85\x1c q"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(200)]
    coder = packing.Coder(FILE)
    got = [np.frombuffer(coder.encode(t), "<u4").tolist() + [0] for t in texts]
    assert got == library_ids(texts)


def test_knapsack_is_the_best_multiset():
    rng = np.random.default_rng(1)
    lengths, price = np.array([3, 5, 7, 11]), rng.random(4)
    value, last = packing.knapsack(lengths, price, 30)
    best = np.full(31, -1.0)
    best[0] = 0
    for room in range(1, 31):
        best[room] = max([best[room - 1], *[best[room - s] + p for s, p in zip(lengths, price) if s <= room]])
    assert np.allclose(value, best)


def least(h, room=2048):
    """A lower bound on the number of sequences: for each a, pieces over room - a are alone, those over half take one each, and what
    these leave free is all that pieces from a to half can use."""
    best = 0
    for a in range(room // 2 + 1):
        alone = sum(n for k, n in h.items() if k > room - a)
        big = [(k, n) for k, n in h.items() if room / 2 < k <= room - a]
        small = sum(k * n for k, n in h.items() if a <= k <= room / 2)
        one = sum(n for _, n in big)
        best = max(best, alone + one + max(0, -(-(small - (one * room - sum(k * n for k, n in big))) // room)))
    return best


def test_plans_are_near_their_bound():
    rng = random.Random(2)
    cases = [
        ({2048: 5}, 1), ({1: 7}, 1), ({1025: 10}, 1), ({1025: 30, 1023: 30}, 1), ({1100: 50, 940: 80, 500: 90}, 1.03), ({1: 100_000, 2047: 10}, 1), ({1500: 10**9, 548: 10**9, 37: 10**8}, 1.001),
        ({rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(300)}, 1.015), ({rng.randrange(1, 700): rng.randrange(1, 500) for _ in range(300)}, 1.001), ({rng.randrange(500, 1100): rng.randrange(1, 5000) for _ in range(200)}, 1.05),
    ]
    for h, over in cases:
        contents, bound = packing.plan(h)
        assert whole(contents) == Counter(h)
        assert bound <= sum(contents.values()) * (1 + 1e-9) and least(h) <= sum(contents.values()) <= over * least(h) + 1, (h, sum(contents.values()), least(h))
    assert sum(packing.plan({683: 9})[0].values()) == 5 and sum(packing.plan({700: 300, 648: 300})[0].values()) == 200
    assert packing.plan({})[0] == Counter()


def test_the_plan_does_not_grow_with_the_table():
    rng = random.Random(4)
    h = {k: rng.randrange(1, 100) for k in range(1, 2049)}
    small = packing.slots(h, packing.plan(h)[0])
    h = {k: n * 10**7 for k, n in h.items()}
    assert len(packing.slots(h, packing.plan(h)[0])["begin"]) < 4 * len(small["begin"]) + 100_000


def test_odd_rows(spark):
    docs = odd_documents(spark).where("doc_id is not null and doc_id <> 4")
    coder = packing.Coder(FILE)
    placed = packing.pack(packing.pieces(docs, coder))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, library_ids(texts.values())))
    rows = placed.collect()
    check(rows, ids)
    assert max(r.piece for r in rows) > 10
    built = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(docs, placed, coder).collect()}
    assert all(built[r.sequence_id][r.offset : r.offset + r.length] == ids[r.doc_id][r.start : r.start + r.length] for r in rows)
    every = packing.pack(packing.pieces(odd_documents(spark), coder))
    assert every.groupBy("doc_id").count().where("doc_id = 4").first()[1] == 2 and every.where("doc_id is null").count() == 1
    assert every.select("sequence_id", "offset").distinct().count() == every.count()
    empty = packing.pack(packing.pieces(odd_documents(spark, empty=True), coder))
    assert empty.count() == 0 and {"sequence_id", "offset"} <= set(empty.columns)


def test_hot_length_spreads(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 700).otherwise(648).cast("long").alias("length"))
    placed = packing.pack(rows).collect()
    used = Counter()
    for r in placed:
        used[r.sequence_id] += r.length
    assert len(placed) == 3000 and max(used.values()) <= 2048
    assert len(used) == 1000  # three pieces fit a sequence, never four


def test_query(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], library_ids([d.text for d in docs])))
    used = check(op13_packing(spark, DATA).collect(), ids)
    assert used <= -(-sum(map(len, ids.values())) // 2048) + 1
