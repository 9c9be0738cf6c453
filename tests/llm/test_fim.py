import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import common, fim
from glossweave.llm.queries import op11_fim

from .helpers import DATA, odd_documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text):
    """(n, form, prefix_chars, middle_chars, output) of one document by the contract's words."""
    text = text or ""
    units = UNIT.findall(text)
    digits = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    out = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    return [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out.collect()]


def test_elias_fano_selects_every_value():
    rng = random.Random(3)
    for n, top in ((1, 1), (1, 10**9), (5, 5), (200, 250), (1000, 10**7), (4096, 9000)):
        values = np.array(sorted(rng.sample(range(1, top + 1), n)))
        index = fim.elias_fano(values)
        assert [fim.select(index, n, k) for k in range(n + 1)] == [0, *values.tolist()]
    dense = fim.elias_fano(np.arange(1, 8001) * 6)
    assert len(dense) < 8000 * 5 / 8  # 2 + log2(6) bits a value
    assert fim.select(fim.elias_fano(np.zeros(0, np.int64)), 0, 0) == 0


def test_boundaries_over_chunks(monkeypatch):
    texts = ["", " ", "a", "a b", " a  b ", "x\x0b\x0cy", "é z \U0001f600", "ab " * 7 + "\t\n", "  q"]
    for chunk in (1, 2, 3, 1 << 20):
        monkeypatch.setattr(fim, "_CHUNK", chunk)
        for t in texts:
            ends = np.cumsum([len(u) for u in UNIT.findall(t)]).tolist()
            assert fim.boundaries(t).tolist() == ends, (t, chunk)


@pytest.mark.parametrize("hot", [1024, 3])
def test_odd_rows(spark, monkeypatch, hot):
    """Nulls, empty and long texts, marks in texts, repeated rows; also with texts that count as hot from three copies on."""
    monkeypatch.setattr(fim, "PART_ROWS", hot)
    docs = odd_documents(spark)
    more = [(100 + i, t, "en", "a", 0, "", 0.0, 0, "", "") for i, t in enumerate(["a <P> b", "<S>", "x<M", "<" + " P>", "one two three four five <", ">"] + ["the same row"] * 40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = rows_of(docs)
    want = [(r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in docs.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert rows_of(odd_documents(spark, empty=True)) == []


def test_a_distinct_text_is_indexed_once(spark, monkeypatch):
    monkeypatch.setattr(fim, "PART_ROWS", 8)
    docs = spark.createDataFrame([(i, "hot text here" if i % 3 == 0 else f"text {i // 4}") for i in range(120)], "doc_id long, text string")
    out = fim.distinct_texts(docs)
    assert out.count() == 120 and out.select("doc_id").distinct().count() == 120
    assert out.groupBy("text").agg(F.countDistinct("cuts").alias("k")).where("k <> 1").isEmpty()


def test_query(spark):
    got = {r.doc_id: r for r in op11_fim(spark, DATA).collect()}
    docs = common.table(spark, DATA, "documents").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        n, form, p, m, output = brute(d.doc_id, d.text)
        assert tuple(got[d.doc_id]) == (d.doc_id, n, form, p, m, sha(output), sha(d.text or ""))
