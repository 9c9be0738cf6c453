"""Predicates and scalar functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from glossweave.functions import text as X
from glossweave.functions import udfs

CASES = [
    (X.is_markup_only, ['<font face="Iconographia">G</font>', "<img src='foo.dds'/>", "  ", None], ['<font face="Iconographia">k</font><br>Forge', "Search", "<font>real text</font>"]),
    (X.looks_like_identifier, ["DialogueGenericGoodbye", "AudioTemplateElk", "MS08Paralysis", "DCETAttack", "REF_ATTACH_NODE"], ["Quick Draw", "Sounds good. Let's go.", "Ab"]),
    (X.looks_like_audio_template, ["AudioTemplateElk", "AudioTemplate Lurker"], ["Elk"]),
    (X.looks_like_do_not_delete, ["Do Not Delete Me - needed for export to work"], ["Please do not delete this"]),
    (X.looks_like_version_note, ["Retroactive fixes for 4.2.1", "Compatibility patch for 2.0"], ["Steel Sword"]),
    (X.looks_like_internal_fx, ["AtronachFrost fx", "Half fx"], ["Effects", "fx incoming"]),
    (X.looks_like_temp, ["TEMP", "TEMP - LIGHTS OUT", "(temp) FX Placeholder"], ["Temple", "Attempt", "Template"]),
    (X.is_placeholder, ["xxx", "TODO", "n/a"], ["Test the waters", ""]),
    (X.looks_like_acronym, ["YMMP", "NFL"], ["Mr", "TEST", "NFL TEAM", "Nfl"]),
    (X.looks_like_interface_key, ["$TNG_TCT"], ["REF_ATTACH_NODE", "$", "$Trade Settlement"]),
    (X.is_asset_path, [r"Cubemaps\CaveGreenCube_e.dds", "a.nif"], ["Sword", ""]),
    (X.looks_like_name, ["Sword of the North", "1st Blade", ""], ["Sword of doom"]),
    (X.contains_japanese, ["剣", "aカb"], ["Sword", "", None]),
    (X.looks_like_proper_noun, ["Shady Sam", "Rorikstead"], ["This is what", "What!", ""]),
]


@pytest.mark.parametrize("rule,yes,no", CASES, ids=[c[0].__name__ for c in CASES])
def test_rules(spark, rule, yes, no):
    rows = [(t, True) for t in yes] + [(t, False) for t in no]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", rule(F.col("t")).alias("got")).collect()
    assert [r.t for r in got if r.got != r.want] == []


def test_quality_class(spark):
    want = {"": "NoJapanese", "Light Greatsword": "NoJapanese", "軽大剣": "AllJapanese", "<mag>のダメージを与える": "ContainsTagAlphaNumeric", "これはSwordを持つ立派な剣です": "ContainsPartsOfAlphaNumeric", "剣Sword": "ContainsMostOfAlphaNumeric"}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", X.quality_class(F.col("t"))).collect()
    assert dict(map(tuple, got)) == want


def test_tsv_escapes_invert(spark):
    raw = ["a\tb", "a\nb", "a\\nb", "\\", "\\\\t", "", "x\\\ty"]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    assert [r[0] for r in df.select(X.unescape_tsv(X.escape_tsv(F.col("t")))).collect()] == raw
    odd = spark.createDataFrame([(r"a\qb\\n\t",)], "t string").select(X.unescape_tsv(F.col("t"))).first()[0]
    assert odd == "a\\qb\\n\t"


def test_heads_and_forms(spark):
    df = spark.createDataFrame([("Ring of the North",), ("Iron Sword",), ("Bread and Cheese",), ("No Sword",), ("One",), ("Big Iron Sword",)], "t string")
    got = [None if r.s is None else tuple(r.s) for r in df.select(X.split_head(F.col("t")).alias("s")).collect()]
    assert got == [("Ring", "North"), ("Sword", "Iron"), None, None, None, ("Sword", "Big Iron")]
    form = spark.createDataFrame([("FE000800|A.esp",), ("bad",), ("0x1F|B.esm",)], "t string").select(X.parse_form_id(F.col("t")).alias("f")).collect()
    assert [r.f and tuple(r.f) for r in form] == [(0x800, "A.esp"), None, (0x1F, "B.esm")]
    targets = spark.createDataFrame([("Mod.esp|0x015516",), ("mod.esp|00015516",), ("mod.esp|15516",), ("SomeId",)], "t string").select(X.normal_target(F.col("t"))).collect()
    assert [r[0] for r in targets] == ["mod.esp|15516"] * 3 + ["@someid"]


def test_spelling():
    assert udfs.kana_word("frost") == "フロスト" or udfs.kana_word("frost").startswith("フ")
    assert udfs.kana_name("Red Ring") == f"{udfs.kana_word('Red')}・{udfs.kana_word('Ring')}"
    assert udfs.kana_word("stone") == udfs.kana_word("ston")
    assert udfs.kana_word("123") == "123"
