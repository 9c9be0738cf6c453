"""Game records as a table: which fields are text, under which type and index, and what a record is.

The records table replaces the binary plugins: load_order, plugin, form, kind (four-letter signature), editor_id,
fields (map of subrecord to text) and the nested lists that some kinds have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------
NAMED_KINDS = (
    "ACTI ALCH AMMO APPA ARMO AVIF BOOK CELL CONT CLAS DOOR ENCH EXPL FLOR FURN HAZD INGR KEYM LCTN LIGH MESG MGEF MISC PERK PROJ "
    "QUST RACE SCRL SHOU SLGM SPEL TACT TREE WATR WEAP WOOP WRLD NPC_ DIAL"
).split()
#: Further text fields of one value, by kind.
SINGLE_FIELDS = {
    "ACTI": ["RNAM"], "FLOR": ["RNAM"], "LSCR": ["DESC"], "MGEF": ["DNAM"], "WOOP": ["TNAM"], "BOOK": ["DESC", "CNAM"], "AMMO": ["DESC"], "ARMO": ["DESC"],
    "WEAP": ["DESC"], "SPEL": ["DESC"], "SCRL": ["DESC"], "SHOU": ["DESC"], "RACE": ["DESC"], "MESG": ["DESC"], "PERK": ["DESC"], "NPC_": ["SHRT"],
    "REFR": ["FULL"], "AVIF": ["DESC"], "INFO": ["RNAM"], "REGN": ["RDMP"], "GMST": ["DATA"],
}
SLOTS = {0: "head", 1: "hair", 2: "body", 3: "hands", 4: "forearms", 5: "amulet", 6: "ring", 7: "feet", 8: "calves", 9: "shield", 10: "tail", 11: "long hair", 12: "circlet", 13: "ears"}
ARMOR = {"LightArmor": "light armor", "HeavyArmor": "heavy armor", "Clothing": "clothing/accessory"}
FIRST_SLOT = 30
# ----------------------------------------------------------------------------------------------

NESTED = "objectives array<struct<index: int, text: string>>, stages array<struct<index: int, entries: array<string>>>, responses array<struct<number: int, text: string>>, buttons array<string>, effects array<struct<label: string, verb: string>>"
_FIELD = "array<struct<type: string, index: int, text: string>>"


def _field(type_: Column | str, index: Column, text: Column) -> Column:
    t = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(t.alias("type"), index.cast("int").alias("index"), text.alias("text"))


def text_fields(r: DataFrame) -> DataFrame:
    """Every text of every record: load_order, plugin, form, editor_id, dsd_type, index, text.

    Single fields have index 0; quest journal entries stage * 1000 + position; perk labels and verbs of effect n
    2n and 2n + 1, under both of their types. One pass, no shuffle.
    """
    kind = F.col("kind")
    allowed = F.create_map(*[F.lit(x) for k in sorted({*NAMED_KINDS, *SINGLE_FIELDS}) for x in (k, ",".join([*(["FULL"] if k in NAMED_KINDS else []), *SINGLE_FIELDS.get(k, [])]))])
    names = F.split(F.coalesce(F.try_element_at(allowed, kind), F.lit("")), ",")
    single = F.transform(F.filter(F.map_entries("fields"), lambda e: F.array_contains(names, e["key"])), lambda e: _field(F.concat_ws(" ", kind, e["key"]), F.lit(0), e["value"]))
    none = F.array().cast(_FIELD)
    only = lambda k, c: F.when(kind == k, c).otherwise(none)
    stages = F.flatten(F.transform("stages", lambda s: F.transform(s["entries"], lambda x, i: _field("QUST CNAM", s["index"] * 1000 + i, x))))

    def effect(e: Column, n: Column) -> Column:
        both = [_field(t, n * 2 + at, e[part]) for at, part in enumerate(("label", "verb")) for t in ("PERK EPF2", "PERK EPFD")]
        return F.array(*both)

    parts = [
        F.coalesce(single, none),
        only("QUST", F.coalesce(F.transform("objectives", lambda o: _field("QUST NNAM", o["index"], o["text"])), none)),
        only("QUST", F.coalesce(stages, none)),
        only("INFO", F.coalesce(F.transform("responses", lambda o: _field("INFO NAM1", o["number"], o["text"])), none)),
        only("MESG", F.coalesce(F.transform("buttons", lambda t, i: _field("MESG ITXT", i, t)), none)),
        only("PERK", F.coalesce(F.flatten(F.transform("effects", effect)), none)),
    ]
    flat = r.select("load_order", "plugin", "form", "editor_id", F.explode(F.concat(*[p.cast(_FIELD) for p in parts])).alias("f"))
    clean = F.replace("f.text", F.lit("\r"), F.lit(""))
    return flat.select("load_order", "plugin", "form", "editor_id", F.col("f.type").alias("dsd_type"), F.col("f.index").alias("index"), clean.alias("text")).where("text is not null")


def signature(type_name: Column, known: dict[str, str]) -> Column:
    """The signature of a class name: suffixes stripped and looked up, else its first four letters in upper case, padded."""
    stem = F.regexp_replace(type_name, "(Getter)?(Setter)?(BinaryOverlay)?$", "")
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, stem), F.rpad(F.upper(F.substring(stem, 1, 4)), 4, "_"))


def describe(dsd_type: Column, whole: dict[str, str], kinds: dict[str, str], fields: dict[str, str]) -> Column:
    """A type in words: of its own, else field of kind, else kind, else null."""
    look = lambda d, k: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), k)
    kind, field = look(kinds, F.substring_index(dsd_type, " ", 1)), look(fields, F.substring_index(dsd_type, " ", -1))
    return F.coalesce(look(whole, dsd_type), F.concat(F.lit("the "), field, F.lit(" of "), kind), F.concat(F.lit("a string belonging to "), kind))


def armor_context(armor_type: Column, slot_bits: Column) -> Column:
    """Armour kind and the names of the slots whose bits are set; unnamed slots by number."""
    names = F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv])
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("shiftright", slot_bits, b).bitwiseAND(F.lit(1)) == 1)
    slots = F.array_join(F.transform(bits, lambda b: F.coalesce(F.try_element_at(names, b), F.concat(F.lit("slot "), (b + FIRST_SLOT).cast("string")))), "/")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in ARMOR.items() for x in kv]), armor_type)
    return F.concat_ws(", ", kind, F.when(slots != "", F.concat(F.lit("slot: "), slots)))


def person_context(rows: DataFrame, races: DataFrame) -> DataFrame:
    """Add ``context`` to persons: gender, and the race's name as its last contributor gives it."""
    last = races.groupBy("race").agg(F.max_by("name", "load_order").alias("race_name"))
    out = rows.join(last, "race", "left")
    gender = F.when(F.col("female"), "female").otherwise("male")
    return out.withColumn("context", F.concat_ws(", ", gender, F.when(F.coalesce("race_name", F.lit("")) != "", F.concat(F.lit("race: "), "race_name")))).drop("race_name")
