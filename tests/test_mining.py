"""Mined dictionaries: long entries and long chains."""

from glossweave.operators import mining
from glossweave.plans import q_mining


def test_long_entries_are_mined(spark):
    words, runs = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefgh"], " ".join("アイウエオカキク"[k % 8] + "サシスセソタチツ"[k // 8] for k in range(64))
    rows = [(1, " ".join(words) + " " + "long " * 200, runs)]
    got = mining.pair_words(spark.createDataFrame(rows, "row_id long, english string, japanese string")).collect()
    assert len(got) == 1 and len(got[0].ws) == 65 and len(got[0].rs) == 64


def test_induction_mines_the_whole_table(spark, tmp_path):
    """Rows whose keys are all divisible by three give words as well; a word that running text uses is none of them."""
    rows = [(3 * k, f"{name} ring", 1) for k, name in enumerate(("red", "blue", "gold") * 4, 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {r.word for r in q_mining.m01(spark, str(tmp_path)).collect()} == {"ring", "red", "gold", "red ring"}
