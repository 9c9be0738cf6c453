"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from glossweave.sources import files, sinks


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_candidates(spark, tmp_path):
    p = put(tmp_path / "c.tsv", "h1\th2\th3\th4\th5\n1|A\tA.esp\tWEAP FULL\tIron\\tSword\t7\n\nshort\trow\n2|A\tA.esp\tWEAP FULL\tOld\n")
    got = [(r.FormId, r.CurrentText, r.Index, r.Warning) for r in files.candidates(spark, p).orderBy("line_no").collect()]
    assert got == [("1|A", "Iron\tSword", 7, ""), ("2|A", "Old", 0, "")]


def test_header_order_and_missing_columns(spark, tmp_path):
    p = put(tmp_path / "t.tsv", "Japanese\tEnglishText\n剣\tSword\n")
    assert [(r.EnglishText, r.Japanese, r.Notes) for r in files.by_header(spark, p, ["EnglishText", "Japanese", "Notes"]).collect()] == [("Sword", "剣", "")]


def test_find(spark, tmp_path):
    put(tmp_path / "B" / "translations.tsv", "x")
    put(tmp_path / "A" / "translations.tsv", "x")
    assert [f.split("/")[-2] for f in files.find(spark, str(tmp_path))] == ["A", "B"]
    with pytest.raises(FileNotFoundError):
        files.find(spark, str(tmp_path / "A"), "none.tsv")


def test_json_tolerates_bad_files(spark, tmp_path):
    put(tmp_path / "good.json", '[{"form_id": "1|A", "type": "WEAP FULL", "original": "a", "string": "b"}, {"form_id": "2|A", "type": "x", "original": "c", "string": "d"}]')
    put(tmp_path / "bad.json", "not json")
    good, bad = files.json_entries(spark, str(tmp_path / "*.json"))
    assert good.count() == 2 and [r.file.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


def test_xml(spark, tmp_path):
    p = put(tmp_path / "x.xml", "<?xml version='1.0'?><SSTXMLRessources><Params><Addon>A.esp</Addon></Params><Content><String><REC>WEAP:FULL</REC><Source>Sword</Source><Dest>剣</Dest></String><String><REC>WEAP:FULL</REC><Source>None</Source></String></Content></SSTXMLRessources>")
    assert [(r.plugin, r.type, r.english, r.japanese) for r in files.xml_pairs(spark, p).collect()] == [("A.esp", "WEAP FULL", "Sword", "剣")]


def test_interface_round_trip(spark, tmp_path):
    p = put(tmp_path / "i.txt", "﻿$A\tone\r\n$B\ttwo\r\n$A\tlast\r\n", "utf-16-le")
    rows = files.interface(spark, p)
    assert [(r.key, r.value) for r in rows.orderBy("line_no").collect()] == [("$A", "last"), ("$B", "two")]
    out = rows.select("line_no", "key", F.lit("").alias("japanese"), F.col("value").alias("english"))
    sinks.write_interface(out, str(tmp_path / "out.txt"))
    data = (tmp_path / "out.txt").read_bytes()
    assert data.startswith(b"\xff\xfe") and data.decode("utf-16").rstrip("\r\n") == "$A\tlast\r\n$B\ttwo"


def test_ini_mods_plugins(spark, tmp_path):
    p = put(tmp_path / "s.ini", "top=1\n[Patcher]\n;x=1\niEnableNPCPatching = 0\niEnableAmmoPatching=1\n")
    got = {(r.section, r.key): r.value for r in files.ini(spark, p).collect()}
    assert got == {("General", "top"): "1", ("Patcher", "iEnableNPCPatching"): "0", ("Patcher", "iEnableAmmoPatching"): "1"}
    assert [r.toggle for r in files.disabled_toggles(files.ini(spark, p)).collect()] == ["iEnableNPCPatching"]
    m = put(tmp_path / "m.txt", "# c\n+High\n-Off\n+Sep_separator\n+Low\n")
    assert [(r.priority, r.mod) for r in files.mod_list(spark, m).orderBy("priority").collect()] == [(0, "High"), (1, "Low")]
    a = put(tmp_path / "p.txt", "*A.esp\nB.esp\n*C.esp\n")
    active = files.active_plugins(spark, a)
    order = files.load_order(spark.createDataFrame([(0, "Base.esm")], "pos int, plugin string"), spark.createDataFrame([("z.esl",), ("y.esl",)], "plugin string"), active)
    assert [r.plugin for r in order.orderBy("pos").collect()] == ["Base.esm", "y.esl", "z.esl", "A.esp", "C.esp"]


def test_mixed_encodings(spark, tmp_path):
    (tmp_path / "m.ini").write_bytes(b"\xef\xbb\xbfcaf\xc3\xa9\r\ncaf\xe9 \x80\rlast")
    assert [r.line for r in files.mixed_lines(spark, str(tmp_path / "m.ini")).orderBy("line_no").collect()] == ["café", "café €", "last"]


def test_lists(spark, tmp_path):
    w = put(tmp_path / "w.txt", " one \n# no\n\ntwo\n")
    assert sorted(r.word for r in files.word_list(spark, w).collect()) == ["one", "two"]
    g = put(tmp_path / "g.tsv", "Ring\t輪\n#x\ty\nRING\t指輪\nbad\n")
    assert [(r.english, r.japanese) for r in files.glossary(spark, g).collect()] == [("RING", "指輪")]
    o = put(tmp_path / "o.tsv", "English\tJapanese\nOK\tOK\n\tx\n")
    assert [tuple(r) for r in files.phrase_overrides(spark, o).collect()] == [("OK", "OK")]
    assert files.optional_corpus(spark, str(tmp_path / "none.tsv")).count() == 0


def test_tsv_writer_round_trip(spark, tmp_path):
    rows = [("1|A", "A.esp", "WEAP FULL", "Iron\tSword\n\\n", "剣", "note", 3, "", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'Index' else 'string'}" for c in files.TRANSLATIONS))
    sinks.write_tsv(df, str(tmp_path / "out"), files.TRANSLATIONS, "WinningPlugin")
    back = files.translations(spark, str(tmp_path / "out" / "*" / "*.csv")).select(*files.TRANSLATIONS).collect()
    assert [tuple(r) for r in back] == rows
    assert sinks.write_corpus(df.unionByName(df), str(tmp_path / "c"), files.TRANSLATIONS) == 1


def test_json_writer(spark, tmp_path):
    df = spark.createDataFrame([("A.esp", 1, "e", "1|A", 0, "WEAP FULL", "Sword", "剣", "x")], "plugin string, row_id int, editor_id string, form_id string, index int, type string, original string, string string, status string")
    sinks.write_json(df, str(tmp_path / "j"))
    text = next((tmp_path / "j" / "plugin=A.esp").glob("part-*")).read_text()
    assert text.strip() == '[{"editor_id":"e","form_id":"1|A","index":0,"type":"WEAP FULL","original":"Sword","string":"剣","status":"x"}]'
