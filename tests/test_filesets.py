"""File sets that are written as a whole, lines over byte ranges, tolerant reading, and the choice of key phrases."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from glossweave.operators import phrases
from glossweave.sources import files, filesets


def texts(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), encoding="utf-8").read() for d, _, names in os.walk(root) for n in names if not n.startswith(".")}


def test_a_set_replaces_the_root_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = [(f"p {i % 3}/é=%{i % 3}.txt", i, f"line {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "path string, k int, line string").repartition(7)
    assert filesets.write_file_set(df, root, ["k"]) == [f"p {i}/é=%{i}.txt" for i in range(3)]
    assert texts(root) == {f"p {i}/é=%{i}.txt": "﻿" + "".join(f"line {k}\n" for k in range(i, 300, 3)) for i in range(3)}
    filesets.write_file_set(df.limit(0).unionByName(spark.createDataFrame([("only.txt", 1, None)], df.schema)), root, ["k"], bom=False)
    assert texts(root) == {"only.txt": "\n"} and os.listdir(tmp_path) == ["out"]
    bad = df.withColumn("line", F.when(F.col("k") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception):
        filesets.write_file_set(bad, root, ["k"])
    assert texts(root) == {"only.txt": "\n"} and os.listdir(tmp_path) == ["out"]


def test_candidate_list(spark, tmp_path):
    rows = spark.createDataFrame([("A.esp", "2|A", "WEAP FULL", "Sword"), ("B.esp", "1|B", "ARMO FULL", "Boots"), ("A.esp", "1|A", "WEAP FULL", "Axe")], "plugin string, form_id string, type string, text string")
    review = spark.createDataFrame([(1, "second"), (0, "first")], "position int, line string")
    for notes, end in ((review, "## 要レビュー（DSD翻訳は適用されているが、原文が変わった可能性あり）\n  first\n  second\n"), (review.limit(0), "")):
        filesets.write_file_set(filesets.candidate_list(rows, notes, "P", "2026-01-02 03:04:05"), str(tmp_path / "o"), filesets.ORDER)
        assert texts(tmp_path / "o")["candidates.txt"] == (
            "﻿# JP翻訳候補リスト\n# プロファイル: P\n# 生成日時: 2026-01-02 03:04:05\n# 対象候補数: 3\n# 対象範囲: FULL(名前)のみ。DESC/会話文等は今後拡張予定\n\n"
            "## A.esp (2件)\n  1|A\t[WEAP FULL]\tAxe\n  2|A\t[WEAP FULL]\tSword\n\n## B.esp (1件)\n  1|B\t[ARMO FULL]\tBoots\n\n" + end
        )


def test_json_names_and_text(spark, tmp_path):
    rows = spark.createDataFrame([("A.esp", 2, "1|A", "", 0, "WEAP FULL", 'say "x"', "剣", "s"), ("A.esp", 1, "2|A", "Ed", 3, "MISC FULL", "a\\b", "é<", "")], "plugin string, row_id int, form_id string, editor_id string, index int, type string, original string, string string, status string")
    filesets.write_file_set(filesets.json_lines(rows, "20260102030405"), str(tmp_path / "o"), filesets.ORDER, bom=False)
    (path, text), *more = texts(tmp_path / "o").items()
    assert not more and path == "SKSE/Plugins/DynamicStringDistributor/A.esp/zzz_SJPTS_20260102030405.json"
    entry = lambda *v: "  {\n" + ",\n".join(f'    "{k}": {x}' for k, x in zip(("form_id", "editor_id", "index", "type", "original", "string", "status"), v)) + "\n  }"
    assert text == "[\n" + entry('"2|A"', '"Ed"', "3", '"MISC FULL"', '"a\\\\b"', '"é<"', '""') + ",\n" + entry('"1|A"', '""', "0", '"WEAP FULL"', '"say \\"x\\""', '"剣"', '"s"') + "\n]\n"
    good, bad = files.json_entries(spark, str(tmp_path / "o" / path))
    assert good.count() == 2 and bad.count() == 0


def test_reports(spark, tmp_path):
    per = spark.createDataFrame([("B.esp", 2, 2, 10, 0, [], "b"), ("A.esp", 4, 1, 5, 15, ["x" * 60, "y"], "a")], "plugin string, total int, resolved int, resolved_chars int, remaining_chars int, samples array<string>, dir string")
    plugins = spark.createDataFrame([(0, "A.esm"), (1, "b.ESP")], "pos int, plugin string")
    spelled = spark.createDataFrame([("frost", "フロスト", "official", "a"), ("Bone", "ボーン", "derived", None)], "english string, japanese string, origin string, source string")
    meaning = spark.createDataFrame([("sword", "剣", "modifier", ""), ("boots", "靴", "head", "x")], "english string, japanese string, kind string, source string")
    merged = spark.createDataFrame([("Blade", "刃", 0, ""), ("New", None, 3, "New Hat"), ("Old", "", 3, "Old Hat")], "word string, japanese string, n int, example string")
    sets = [filesets.translation_index(per, "T"), filesets.auto_resolve(per), filesets.active_plugins(plugins, per), filesets.derived_tables(spelled, meaning), filesets.glossary_template(merged, ["", "Fill in."], ["word", "japanese", "n", "example"], F.lit("g/A.tsv"))]
    every = sets[0]
    for s in sets[1:]:
        every = every.unionByName(s)
    filesets.write_file_set(every, str(tmp_path / "o"), filesets.ORDER, bom=False)
    got = texts(tmp_path / "o")
    assert got["translation_index.txt"] == "# Translation 一括生成インデックス（候補数の多い順）\n# 生成日時: T\n# プラグイン数: 2, 候補総数: 6, 自動解決: 3\n\n     4件（自動解決    1件）\tA.esp\ta\n     2件（自動解決    2件）\tB.esp\tb\n"
    index = got["auto_resolve_by_plugin.tsv"].split("\n")
    assert index[1].split("\t")[:9] == ["A.esp", "4", "1", "3", "25.0", "20", "5", "15", "25.0"] and index[2] == "B.esp\t2\t2\t0\t100.0\t10\t10\t0\t100.0\t"
    assert got["active_plugins.tsv"] == "Index\tFileName\tHasTranslatableContent\n0\tA.esm\tFalse\n1\tb.ESP\tTrue\n"
    assert got["derived_transliteration_dict.tsv"] == "English\tJapanese\tOrigin\tSource\nBone\tボーン\tderived\t\nfrost\tフロスト\tofficial\ta\n"
    assert got["derived_meaning_dict.tsv"] == "English\tJapanese\tKind\tSource\nboots\t靴\thead\tx\nsword\t剣\tmodifier\t\n"
    assert got["g/A.tsv"] == "#\n# Fill in.\n# English\tJapanese\tRemaining\tExample\nNew\t\t3\tNew Hat\nOld\t\t3\tOld Hat\nBlade\t刃\t0\t\n"


def test_lines_over_byte_ranges(spark, tmp_path):
    rng = random.Random(4)
    want = []
    for k in range(3):
        data = "﻿" if k else ""
        for i in range(4000):
            data += f"{i} " + "é日" * rng.randrange(0, 20) + rng.choice(["\n", "\r\n", "\r", "\n\n"])
        (tmp_path / f"{k}.txt").write_bytes(data.encode())
        want += [(k, n, x) for n, x in enumerate(re.split("\r\n|\r|\n", data.removeprefix("﻿"))[:-1], 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        df = files.lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [(int(r.file.rsplit("/", 1)[1][0]), r.line_no, r.line) for r in df.collect()]
        mixed = [(int(r.file.rsplit("/", 1)[1][0]), r.line_no, r.line) for r in files.mixed_lines(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == want == sorted(mixed)


def test_broken_rows_and_files_are_listed(spark, tmp_path):
    a, b = tmp_path / "a.tsv", tmp_path / "b.tsv"
    a.write_bytes("h\n1|A\tA\tWEAP FULL\tSword\t7\nshort\trow\n\n2|A\tA\tx\tHat\tseven\n".encode() + b"3|A\tA\tx\t\xff\xfe\t1\n")
    b.write_text("h\n4|B\tB\tx\tBow\n")
    columns = ["FormId", "Plugin", "Type", "Text", "Index"]
    rows = files.checked(spark, [str(a), str(b), str(tmp_path / "none.tsv")], columns, 4, ["Index"]).collect()
    assert sorted((r.FormId, r.Text, r.Index) for r in rows if r.error is None) == [("1|A", "Sword", 7), ("4|B", "Bow", 0)]
    assert sorted((r.file.rsplit("/", 1)[1], r.line_no or 0, r.error) for r in rows if r.error) == [("a.tsv", 3, "only 2 columns"), ("a.tsv", 5, "Index is no number"), ("a.tsv", 6, "not UTF-8"), ("none.tsv", 0, "no such file")]


def test_key_phrases_equal_the_walk(spark):
    rng = random.Random(8)
    words = ["Red", "Iron", "Old", "Blade", "of", "War", "Hat"]
    rows = {(g, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))): float(rng.randrange(1, 40)) for g in range(3) for _ in range(2500)}
    df = spark.createDataFrame([(g, p, s) for (g, p), s in rows.items()], "grp int, gram string, score double")
    got = {(r.grp, r.gram) for r in phrases.key_phrases(df, "grp", spark.createDataFrame([("Red Hat",)], "gram string")).collect()}
    want = set()
    for g in range(3):
        kept = []
        for p in sorted((p for h, p in rows if h == g and p != "Red Hat"), key=lambda p: (-rows[g, p], -len(p.split(" ")), p)):
            if len(kept) < 10 and not any(p in k or k in p for k in kept):
                kept.append(p)
        want |= {(g, p) for p in kept}
    assert got == want and phrases.key_phrases(df.limit(0), "grp").count() == 0
