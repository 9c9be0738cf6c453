"""Records, contexts and instances."""

import pytest
from pyspark.sql import functions as F

from glossweave.operators import records
from glossweave.sources import files, instance

SCHEMA = f"load_order int, plugin string, form string, kind string, editor_id string, fields map<string,string>, {records.NESTED}"


def row(kind, fields=None, objectives=None, stages=None, responses=None, buttons=None, effects=None):
    return (0, "A.esp", "1|A", kind, "e", fields or {}, objectives, stages, responses, buttons, effects)


def test_text_fields(spark):
    rows = [
        row("WEAP", {"FULL": "Sword\r", "DESC": "Sharp", "XXXX": "no"}),
        row("QUST", {"FULL": "Q"}, [(10, "Go")], [(5, ["a", "b"])]),
        row("INFO", {"RNAM": "Ask"}, None, None, [(1, "Hi"), (2, "Bye")]),
        row("MESG", {"DESC": "m"}, None, None, None, ["Yes", "No"]),
        row("PERK", {}, None, None, None, None, [("Use", "Take"), (None, None)]),
        row("ZZZZ", {"FULL": "no"}),
    ]
    got = sorted((r.dsd_type, r["index"], r.text) for r in records.text_fields(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(
        [("WEAP FULL", 0, "Sword"), ("WEAP DESC", 0, "Sharp"), ("QUST FULL", 0, "Q"), ("QUST NNAM", 10, "Go"), ("QUST CNAM", 5000, "a"), ("QUST CNAM", 5001, "b"), ("INFO RNAM", 0, "Ask"), ("INFO NAM1", 1, "Hi"), ("INFO NAM1", 2, "Bye")]
        + [("MESG DESC", 0, "m"), ("MESG ITXT", 0, "Yes"), ("MESG ITXT", 1, "No"), ("PERK EPF2", 0, "Use"), ("PERK EPFD", 0, "Use"), ("PERK EPF2", 1, "Take"), ("PERK EPFD", 1, "Take")]
    )


def test_contexts(spark):
    df = spark.createDataFrame([("HeavyArmor", 0b101), (None, 1 << 20), (None, 0)], "t string, s int")
    assert [r[0] for r in df.select(records.armor_context(F.col("t"), F.col("s"))).collect()] == ["heavy armor, slot: head/body", "slot: slot 50", ""]
    people = spark.createDataFrame([(1, "r1", True), (2, "r2", False)], "id int, race string, female boolean")
    races = spark.createDataFrame([("r1", 1, "Old"), ("r1", 2, "Elf")], "race string, load_order int, name string")
    assert [r.context for r in records.person_context(people, races).orderBy("id").collect()] == ["female, race: Elf", "male"]
    names = spark.createDataFrame([("WeaponGetter",), ("OddBinaryOverlay",), ("NpcBinaryOverlay",)], "n string")
    assert [r[0] for r in names.select(records.signature(F.col("n"), {"Weapon": "WEAP", "Npc": "NPC_"})).collect()] == ["WEAP", "ODD_", "NPC_"]
    kinds = spark.createDataFrame([("WEAP FULL",), ("WEAP XXXX",), ("GMST DATA",), ("ZZZZ FULL",)], "t string")
    got = [r[0] for r in kinds.select(records.describe(F.col("t"), {"GMST DATA": "a setting"}, {"WEAP": "a weapon"}, {"FULL": "name"})).collect()]
    assert got == ["the name of a weapon", "a string belonging to a weapon", "a setting", None]


def test_instance(spark, tmp_path):
    p = tmp_path / "profiles" / "Main"
    p.mkdir(parents=True)
    (tmp_path / "ModOrganizer.ini").write_text("[General]\nselected_profile=@ByteArray(Main)\n")
    (p / "modlist.txt").write_text("+High\n+Low\n")
    (p / "plugins.txt").write_text("*B.esp\n*A.esp\n")
    i = instance.read(spark, str(tmp_path))
    assert i.profile == "Main" and i.mods.count() == 2
    present = spark.createDataFrame([("a.esp",), ("b.esp",), ("update.esm",)], "plugin string")
    got = instance.order(spark, i, present, spark.createDataFrame([], "plugin string"))
    assert [r.plugin for r in got.orderBy("pos").collect()] == ["Update.esm", "B.esp", "A.esp"]
    with pytest.raises(FileNotFoundError):
        instance.read(spark, str(tmp_path / "none"))
    w = spark.createDataFrame([("Strings/a.txt", "mod")], "path string, location string")
    g = spark.createDataFrame([("strings/A.txt", "game"), ("b.txt", "game")], "path string, location string")
    assert sorted(r.location for r in instance.staged(w, g).collect()) == ["game", "mod"]
    assert files.plugin_paths(spark.createDataFrame([("A", "m", 1, 0), ("a", "o", 0, 5)], "name string, path string, tier int, priority int")).first().path == "o"
