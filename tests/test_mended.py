"""Cases that an earlier version got wrong."""

from pyspark.sql import functions as F

from glossweave.functions import text as X
from glossweave.operators import iface, mining


def test_unescape_keeps_control_characters(spark):
    rows = [("a\u0001b",), ("\\\\t",), ("x\\ty\\\\n\\n",), ("\\\\\\t",), ("\\q\\",), ("",), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "s string").select(X.unescape_tsv(F.col("s")).alias("s")).collect()]
    assert got == ["a\u0001b", "\\t", "x\ty\\n\n", "\\\t", "\\q\\", "", ""]


def test_short_targets_find_their_file(spark):
    wanted = spark.createDataFrame([("ab",), ("Exact",), ("none",), ("a",)], "target string")
    files = spark.createDataFrame([("abcdef",), ("exact",), ("exactly",), ("ABx",)], "name string")
    assert dict(iface.prefix_match(wanted, files).collect()) == {"ab": "ABx", "Exact": "exact", "a": "ABx"}
    assert iface.prefix_match(wanted.limit(0), files).count() == 0


def test_words_with_apostrophes_have_witnesses(spark):
    corpus = spark.createDataFrame([(1, "King's blade", "キングス"), (2, "the king", "キング")], "row_id long, english string, japanese string")
    mined = spark.createDataFrame([("king's", "キングス"), ("king", "キング")], "word string, run string")
    assert sorted(tuple(r) for r in mining.vouched(mined, corpus).collect()) == [("king", "キング", 2), ("king's", "キングス", 1)]


def test_implausible_run_does_not_hide_a_plausible_one(spark):
    table = spark.createDataFrame([("frost", "マジック", 3, 3, 3, 1.0), ("frost", "フロスト", 3, 3, 4, 0.8)], "word string, run string, together long, word_n long, run_n long, dice double")
    from glossweave.functions import udfs

    got = mining.best_pairs(table, credible=udfs.plausible(F.col("word"), F.col("run"))).collect()
    assert [(r.word, r.run) for r in got] == [("frost", "フロスト")]
