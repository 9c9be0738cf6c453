"""Chains, precedents, coverage, INI gates."""

from pyspark.sql import functions as F

from glossweave.functions import text as X
from glossweave.operators import batch, corpus, coverage, inipatch, overlay, reports
from glossweave.streaming import upsert


def test_precedent_walk_back(spark):
    chains = {
        "confirmed": ["Same Item", "旧訳", "新訳", "Same Item"],
        "mismatch": ["Original Item A", "古い翻訳A", "新しい翻訳A", "Repurposed Item B"],
        "origin": ["彼岸の剣", "Foreign Cursed Sword"],
        "to_start": ["旧訳", "新訳", "Something"],
        "none": ["Only English"],
    }
    rows = [(k, i, t) for k, v in chains.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    got = {r.k: (r.japanese, r.needs_review, r.skipped_japanese, r.skipped_reference) for r in overlay.precedent(df, ["k"], ["o"], "t", X.contains_japanese(F.col("t"))).collect()}
    assert got == {
        "confirmed": ("新訳", False, None, None),
        "mismatch": (None, False, "新しい翻訳A", "Original Item A"),
        "origin": ("彼岸の剣", True, None, None),
        "to_start": ("新訳", True, None, None),
        "none": (None, False, None, None),
    }


def test_coverage_strategies(spark):
    entries = spark.createDataFrame(
        [("GMST DATA", "9|Z", 0, "sEdid", "Old", "訳", "x", 1), ("QUST CNAM", "1|A", 99999, "", "Stage text", "訳2", "x", 2), ("WEAP FULL", "2|A", 0, "", "Steel Blade Old", "訳3", "x", 3), ("WEAP FULL", "2|A", 0, "", "later", "訳4", "x", 4)],
        "type string, form_id string, index int, editor_id string, original string, string string, status string, entry_no int",
    )
    records = spark.createDataFrame(
        [("GMST DATA", "1|A", 0, "SEDID", "Old"), ("GMST DATA", "9|Z", 0, "other", "Old"), ("QUST CNAM", "1|A", 5, "", "Stage text"), ("WEAP FULL", "2|A", 0, "", "Steel Blade")],
        "record_type string, form_id string, index int, editor_id string, text string",
    )
    got = {(r.record_type, r.editor_id): (r.covered and r.covered.string, r.is_covered, r.is_stale) for r in coverage.judge(coverage.lookup(records, entries)).collect()}
    assert got == {("GMST DATA", "SEDID"): ("訳", True, False), ("GMST DATA", "other"): (None, False, False), ("QUST CNAM", ""): ("訳2", True, False), ("WEAP FULL", ""): ("訳3", True, True)}


def ini(spark, rows, active=("a.esp",), disabled=()):
    df = spark.createDataFrame(rows, "path string, line_no int, line string")
    arr = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return {(r.line_no, r.kind): (r.dsd_type, r.text, r.inactive, r.occurrence) for r in inipatch.evaluate(df, arr(active), arr(disabled)).collect()}


def test_ini_lines(spark):
    got = ini(spark, [("npc\\x.ini", 1, "filterByNpcs=a.esp|1:fullName=~A: B~:shortName=~C~"), ("npc/x.ini", 2, "; fullName=~no~"), ("npc/x.ini", 3, "filterByNpcs=a.esp|2:weight=1")])
    assert got == {(1, "FullName"): ("NPC_ FULL", "A: B", "", 1), (1, "ShortName"): ("NPC_ SHRT", "C", "", 1)}


def test_ini_gates(spark):
    name = ":fullName=~x~"
    rows = [("weapon/Gone.esp.ini", 1, "filterByWeapons=a.esp|1" + name), ("weapon/f.ini", 2, "hasPlugins=A.esp,b.esp:filterByWeapons=a.esp|2" + name), ("weapon/f.ini", 3, "hasPluginsOr=A.esp,b.esp:filterByWeapons=a.esp|3" + name), ("weapon/f.ini", 4, "filterByWeapons=b.esp|4" + name), ("weapon/f.ini", 5, "filterByWeapons=SomeId" + name), ("weapon/Foo.esp.bak.ini", 6, "filterByWeapons=a.esp|9" + name)]
    got = {k[0]: v[2] for k, v in ini(spark, rows).items()}
    assert got == {1: "FileGate", 2: "LineGate", 3: "", 4: "TargetPluginMissing", 5: "", 6: ""}
    assert ini(spark, rows[:1], disabled=["iEnableWeaponPatching"])[1, "FullName"][2] == "TypeDisabled"


def test_ini_overrides(spark):
    f = lambda n, t: ("weapon/f.ini", n, f"filterByWeapons={t}:fullName=~{n}~")
    got = {k[0]: v[2] for k, v in ini(spark, [f(1, "a.esp|0x015516"), f(2, "a.esp|15516"), f(3, "a.esp|00015516,a.esp|7"), f(4, "a.esp|7")]).items()}
    assert got == {1: "OverriddenInSameFile", 2: "OverriddenInSameFile", 3: "", 4: ""}


def test_exact_dictionary(spark):
    rows = [(1, "Iron Dagger", "鉄の短剣x", "dsd", "WEAP FULL"), (2, "Iron Dagger", "鉄の短剣", "vanilla", "WEAP FULL"), (3, "Druid", "ドルイドの", "imported", "NPC_ FULL"), (4, "Beta", "ベータ", "vanilla", "MGEF FULL"), (5, "Beta", "ベータ2", "dsd", "NPC_ FULL"), (6, "OK", "x", "vanilla", "")]
    c = spark.createDataFrame(rows, "row_id long, english string, japanese string, kind string, type string")
    d = corpus.exact_dictionary(c, spark.createDataFrame([], "key string"), spark.createDataFrame([("OK", "OK")], "english string, japanese string"))
    got = {r.key: (r.japanese, r.tier, r.npc_name) for r in d.collect()}
    assert got == {"Iron Dagger": ("鉄の短剣", 0, False), "Beta": ("ベータ", 0, True), "OK": ("OK", -1, False)}


def test_batches():
    assert list(batch.packs(["aa", "bb", "ccccc", "d"], 4)) == [["aa", "bb"], ["ccccc"], ["d"]]
    assert batch.match_back(["a", " b", '"c"'], {"a": "1", "b": "2", "c": '"3"'}) == {"a": "1", " b": "2", '"c"': "3"}

    class Broken:
        def translate(self, texts, hints, timeout):
            raise OSError

    g = batch.Guarded(Broken())
    assert g.translate(["a"], []) == {} and g.open and g.calls == 3 and g.translate(["b"], []) == {} and g.calls == 3
    seen, errors = [], []
    batch.tolerant(["1", "x", "2"], lambda v: seen.append(int(v)), errors.append)
    assert seen == [1, 2] and len(errors) == 1


def test_upsert_keeps_human_input(spark):
    old = spark.createDataFrame([("Blade", "刃"), ("Gone", "x")], "word string, japanese string")
    new = spark.createDataFrame([("BLADE", 5), ("New", 2)], "word string, n long")
    got = {r.word: (r.japanese, r.n) for r in reports.upsert(old, new, "word", "japanese", ["n"]).collect()}
    assert got == {"Blade": ("刃", 5), "Gone": ("x", 0), "New": ("", 2)}


def test_stream_upsert(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("k1", 1, "a"), ("k1", 3, "c"), ("k2", 1, "x")], "k string, v int, ja string").write.parquet(str(src))
    store = [spark.createDataFrame([("k1", 2, "b"), ("k3", 1, "z")], "k string, v int, ja string")]
    stream = spark.readStream.schema("k string, v int, ja string").parquet(str(src))
    q = upsert.run(stream, lambda: store[-1], lambda df: store.append(spark.createDataFrame(df.collect(), df.schema)), ["k"], "v", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(map(tuple, store[-1].collect())) == [("k1", 3, "c"), ("k2", 1, "x"), ("k3", 1, "z")]
