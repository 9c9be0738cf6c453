"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossweave.llm import common, mixing, sharding
from glossweave.llm.queries import op3_sharding, op4_mixing

from .helpers import DATA, odd_documents


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        order = np.argsort(sharding.hilbert_index(cells, bits))
        assert sorted(sharding.hilbert_index(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in common.table(spark, DATA, "documents").select("doc_id", "text").collect()}
    got = op3_sharding(spark, DATA).collect()
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        body = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 16, zlib.crc32(body)) and r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_sharding_odd_rows(spark, tmp_path):
    out = sharding.shard(odd_documents(spark), 5)
    assert out.count() == 12 and sorted(Counter(r.shard for r in out.collect()).values()) == [2, 2, 2, 3, 3]
    assert sharding.shard(odd_documents(spark, empty=True), 5).count() == 0
    assert {r.shard for r in sharding.shard(odd_documents(spark).limit(2), 40).collect()} <= set(range(40))
    with pytest.raises(ValueError):
        sharding.shard(odd_documents(spark), 5, bits=10)
    docs = odd_documents(spark).where("doc_id > 4")
    sharding.write(docs, sharding.shard(docs, 3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_curve_prunes(spark):
    docs = common.table(spark, DATA, "documents")
    rows = sharding.shard(docs, 10).join(docs.select("doc_id", "lang"), "doc_id").collect()
    kinds = defaultdict(set)
    for r in rows:
        kinds[r.shard].add(r.lang)
    assert sum(map(len, kinds.values())) < 10 * len({r.lang for r in rows})


def test_targets():
    assert mixing.targets([100, 100], [3, 1]) == [200, 100]
    got = mixing.targets([10, 1000, 500, 0], [3, 1, 2, 3])
    assert abs(sum(got) - 1.5 * 1510) < 1e-6 and all(g <= 2 * s + 1e-9 for g, s in zip(got, [10, 1000, 500, 0]))
    assert mixing.targets([], []) == []


def test_mixing_query(spark):
    got = op4_mixing(spark, DATA).collect()
    source = {r.doc_id: r.source for r in common.table(spark, DATA, "documents").select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(got) == len(source) and all(abs(taken[s] - t) <= 0.01 * t + 64 for s, t in target.items())
    assert sorted(map(tuple, got)) == sorted(map(tuple, op4_mixing(spark, DATA).collect()))


def test_schedule_is_even(spark):
    """Every tenth of the schedule is mixed like the whole."""
    documents, schedule = mixing.mix(common.table(spark, DATA, "documents"))
    src = {r.row: r.source for r in documents.collect()}
    target = {r.source: r.target for r in documents.collect()}
    rows = schedule.collect()
    top = max(r.slot for r in rows) + 1
    for k in range(10):
        part = Counter()
        for r in rows:
            if r.slot * 10 // top == k:
                part[src[r.row]] += r.words
        total = sum(part.values())
        assert all(abs(part[s] / total - t / sum(target.values())) < 0.01 for s, t in target.items())


def test_mixing_odd_rows(spark):
    got = mixing.taken(*mixing.mix(odd_documents(spark))).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r["size"] for r in got)
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.taken(*mixing.mix(odd_documents(spark, empty=True))).count() == 0
