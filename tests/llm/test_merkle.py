import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from glossweave.llm import common, merkle
from glossweave.llm.queries import id_crc, op12_merkle

from .helpers import DATA, odd_documents

FIELDS = "doc_id", "source", "lang", "n_chars", "text"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    values = [r[f] if f != "text" else text for f in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, place):
    """The siblings of a leaf on every level, as (before, after)."""
    out = []
    for nodes in levels[:-1]:
        first = place - place % 8
        run = nodes[first : first + 8]
        out.append((run[: place - first], run[place - first + 1 :]))
        place //= 8
    return out


def brute(rows):
    rows = sorted(rows, key=lambda r: (r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    trees = {k: climb([leaf(r, r.text) for r in v]) for k, v in langs.items()}
    top = climb([t[-1][0] for t in trees.values()])
    root, out = top[-1][0], []
    for at, (k, members) in enumerate(langs.items()):
        for place, r in enumerate(members):
            steps = path(trees[k], place) + path(top, at)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            h = leaf(r, r.text.translate(LOWER) if hit and r.text is not None else r.text)
            for before, after in steps:
                h = sha("".join([*before, h, *after]))
            proof = "".join("".join(b + a) for b, a in steps)
            out.append((r.doc_id, leaf(r, r.text), trees[k][-1][0], root, sha(proof), h, h == root))
    return out


def rows_of(df):
    out = merkle.manifest(df, tampered=id_crc() % 3 == 0)
    digest = F.sha2(F.col("proof").cast("binary"), 256)
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", digest, "folded_root", "verified").collect()]


def documents(spark, n, langs):
    rows = [(i, f"Text {i} ÉA", None if langs and i % langs == 0 else f"l{i % langs if langs else 0}", "s", i) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("n, langs", [(1, 0), (8, 0), (9, 0), (65, 0), (600, 0), (5, 5), (60, 20), (700, 3)])
def test_sizes_of_trees(spark, n, langs):
    docs = documents(spark, n, langs)
    assert sorted(rows_of(docs), key=repr) == sorted(brute(docs.collect()), key=repr)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 0)
    docs = documents(spark, 300, 11)
    assert sorted(rows_of(docs), key=repr) == sorted(brute(docs.collect()), key=repr)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = rows_of(docs)
    assert sorted(got, key=repr) == sorted(brute(docs.collect()), key=repr) and len(got) == 12
    empty = merkle.manifest(odd_documents(spark, empty=True))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def test_untampered_rows_verify(spark):
    assert {r.verified for r in merkle.manifest(documents(spark, 100, 4)).collect()} == {True}


def test_query(spark):
    got = sorted(tuple(r) for r in op12_merkle(spark, DATA).collect())
    want = sorted(brute(common.table(spark, DATA, "documents").collect()))
    assert got == want and {r[-1] for r in got} == {True, False}
