"""Odd rows that every operator must survive."""

import os
import zlib

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, component_id long, ids string, _text string"


def odd_documents(spark, empty: bool = False):
    """Nulls in every column, empty and white texts, repeated rows, a very long text, other scripts, and columns whose
    names clash with those that operators make."""
    long = "word " * 60_000
    rows = [
        (1, None, None, None), (None, "no id here", "en", "a"), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "the same row", "en", "a"), (4, "the same row", "en", "a"),
        (5, long, "en", "b"), (6, "日本語の文章です。Ünïcödé \U0001f600", "xx", "b"), (7, "1234 5678 !!!", "en", "c"), (8, "a", None, "c"), (9, "the same row", "de", None), (10, "Le chat est là", "fr", "a"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), "x", 0.5, -1, "y", "z") for i, t, lang, s in rows]
    return spark.createDataFrame([] if empty else full, DOCS)


def crc(i) -> int:
    return zlib.crc32(str(i).encode())
