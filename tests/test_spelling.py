"""Transliteration from pieces against a fold over one word at a time."""

import random

from glossweave.operators import cascade, spelling
from pyspark.sql import functions as F

PIECES = [("Frost", "フロスト", "a", True), ("Fall", "フォール", "", True), ("mere", "メア", "", False), ("fro", "フロ", "", False), ("stfall", "ストフォール", "", False), ("Whiterun", "ホワイトラン", "b", True), ("riften", "リフテン", "", False), ("ice", "アイス", "", False)]


def table(spark):
    return spark.createDataFrame(PIECES, "word string, kana string, source string, alone boolean")


def brute(word, pieces):
    word = word.lower()
    known = {w.lower(): (k, a) for w, k, _, a in pieces}
    if word in known and known[word][1]:
        return known[word][0]
    best = {len(word): ""}
    for i in range(len(word) - 1, -1, -1):
        for j in range(len(word), i + 2, -1):
            if j in best and (i, j) != (0, len(word)) and word[i:j] in known:
                best[i] = known[word[i:j]][0] + best[j]
                break
    return best.get(0) or None


def test_cases(spark):
    names = ["Frostfall", "FROSTMERE", "Frost", "Riften", "Whiterun", "Icefall", "Frost-fall", "Qux", "Urag Frost", "Frost Fall", "Whiterun Frostmere", "Riften Fall", "frost fall", "Frost Fall!", "", None, "123", "Frost 12", "Frost Frost"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.japanese, r.detail) for r in spelling.transliterate(rows, table(spark)).collect()}
    assert {n: j for n, (j, _) in got.items()} == {
        "Frostfall": "フロストフォール", "FROSTMERE": "フロストメア", "Frost": "フロスト", "Whiterun": "ホワイトラン", "Icefall": "アイスフォール", "Frost-fall": "フロストフォール", "Frost Fall": "フロスト・フォール",
        "Whiterun Frostmere": "ホワイトラン・フロストメア", "Frost Frost": "フロスト・フロスト",
    }
    assert got["Frostfall"][1] == '"frostfall"→"フロストフォール"(frost+fall)' and got["Whiterun"][1] == '"whiterun"→"ホワイトラン"'


def test_random_words(spark):
    rng = random.Random(9)
    pieces = {"".join(rng.choices("ab", k=rng.randrange(3, 6))): rng.random() < 0.3 for _ in range(14)}
    rows = [(w, f"<{w}>", "s", alone) for w, alone in sorted(pieces.items())]
    words = {"".join(rng.choices("ab", k=rng.randrange(1, 16))) for _ in range(400)} | set(pieces)
    got = spelling.decompose(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(rows, "word string, kana string, source string, alone boolean"))
    got = {r.word: (r.kana, "".join(p.kana for p in r.parts)) for r in got.collect()}
    want = {w: brute(w, rows) for w in words}
    assert {w: k for w, (k, _) in got.items()} == {w: k for w, k in want.items() if k} and all(a == b for a, b in got.values())


def test_stages_see_what_is_left(spark):
    """A stage gets the rows that earlier ones left; switched-off stages are not asked."""
    seen = {}

    def stage(name, keep):
        def run(rows):
            seen[name] = sorted(r.k for r in rows.collect())
            return rows.withColumn("answer", F.when(keep, cascade.told(F.concat(F.lit("訳"), F.col("k").cast("string")), name)))

        return run

    rows = spark.range(12).select(F.col("id").alias("k"))
    stages = {"cloud_llm": stage("cloud_llm", F.col("k") < 100), "exact": stage("exact", F.col("k") % 2 == 0), "preserved": stage("preserved", F.col("k") < 3), "meaning": stage("meaning", F.col("k") % 3 == 0)}
    out = {r.k: r.stage for r in cascade.run(rows, stages, {"preserved", "exact", "meaning"}).collect()}
    assert seen == {"preserved": list(range(12)), "exact": list(range(3, 12)), "meaning": [3, 5, 7, 9, 11]}
    assert out == {0: "preserved", 1: "preserved", 2: "preserved", 4: "exact", 6: "exact", 8: "exact", 10: "exact", 3: "meaning", 9: "meaning", 5: "unresolved", 7: "unresolved", 11: "unresolved"}
    assert cascade.run(rows, stages).where("stage = 'cloud_llm'").count() == 3 and seen["cloud_llm"] == [5, 7, 11]
    assert cascade.run(rows.limit(0), stages).count() == 0
