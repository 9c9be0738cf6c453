"""The whole pipeline: hand-over by Parquet, removal of what was read, and results of the stages one after the other."""

import os
from collections import Counter

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from glossweave.llm import common

from .helpers import DATA


def test_run_equals_its_stages(spark):
    import corpus_pipeline as p

    out = p.run(spark, DATA)
    assert {"doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(out.columns) and "text" not in out.columns
    root = os.path.dirname(out.inputFiles()[0].removeprefix("file:").replace("//", "/").rstrip("/"))
    assert [x for x in os.listdir(os.path.dirname(root)) if not x.startswith(".")] == ["bpe"]
    docs = common.table(spark, DATA, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, DATA))
        assert docs.columns == columns, name
        assert 0 < docs.count() and (name == "mixing" or docs.count() <= seen), name
        seen = docs.count()
    tokenizer = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, r.lang, r.source, tuple(ids)] += 1
    assert Counter((r.doc_id, r.lang, r.source, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out.collect()) == want
