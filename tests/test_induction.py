"""The induced dictionary against a walk through the rows in order, written apart from the operator."""

import random
import re

import pytest

from glossweave.operators import induction

SMALL = {"of", "the", "and", "in", "on", "at", "a", "an"}


def name_like(text):
    return all(any(c.isupper() for c in w) or w.lower() in SMALL or w == "-" or w.isdigit() or re.fullmatch(r"\d+(st|nd|rd|th)", w, re.I) for w in text.split(" ") if w)


def kana(text):
    return bool(text) and all("゠" <= c <= "ヿ" for c in text)


def walk(rows, excluded=(), iterations=100):
    """{word: (english, kana)} by going through the rows one by one."""
    rows = [(i, (e or "").strip(), (j or "").strip()) for i, e, j, *_ in sorted(rows)]
    bad = {x.lower() for x in excluded}
    for _, e, j in rows:
        w = [x for x in e.split(" ") if x]
        if j and len(w) >= 2 and re.fullmatch("[A-Z][A-Za-z]+", w[0]) and w[1].lower() == "of" and not kana(j.replace("・", "")):
            bad.add(w[0].lower())
    found = {}

    def learn(e, j):
        if e and j and e.lower() not in bad and e.lower() not in found and all(re.fullmatch("[A-Za-z]{2,}", p) for p in re.split("[ -]+", e) if p):
            found[e.lower()] = (e, j)

    def words(text):
        out = []
        for w in (x for x in text.split(" ") if x):
            out += [((" " if h == 0 else "-"), p) for h, p in enumerate(x for x in w.split("-") if x)]
        return out

    def said(parts):
        return "".join(g + p for g, p in parts)[1:]

    def settle(parts, segs):
        if parts and len(parts) == len(segs) and all(map(kana, segs)) and all(re.fullmatch("[A-Za-z]{2,}", p) for _, p in parts):
            for (_, p), s in zip(parts, segs):
                learn(p, s)
            for a in range(len(parts)):
                for b in range(a + 2, len(parts) + 1):
                    learn(said(parts[a:b]), "・".join(segs[a:b]))

    names = [(e, j) for _, e, j in rows if len(e) >= 2 and j and name_like(e)]
    for e, j in names:
        if "・" not in j and kana(j):
            learn(e, j)
    for e, j in names:
        w = [x for x in e.split(" ") if x]
        if len(w) >= 3 and w[1].lower() == "of" and j.find("の") > 0:
            settle(words(" ".join(w[2:])), j[: j.find("の")].split("・"))
    for _ in range(iterations):
        before = len(found)
        for e, j in names:
            if "・" not in j or e.lower() in found:
                continue
            parts, segs = words(e), j.split("・")
            hit = None
            for n in range(len(parts), 0, -1):
                for a in range(len(parts) - n + 1):
                    known = found.get(said(parts[a : a + n]).lower())
                    if known and not hit:
                        sub = known[1].split("・")
                        at = next((i for i in range(len(segs) - len(sub) + 1) if segs[i : i + len(sub)] == sub), None)
                        if at is not None:
                            hit = (a, n, at, len(sub))
            if hit:
                a, n, at, m = hit
                settle(parts[:a], segs[:at])
                settle(parts[a + n :], segs[at + m :])
            else:
                settle(parts, segs)
        if len(found) == before:
            break
    small = {t.lower() for _, e, _ in rows for t in re.split("[ -]", e) if t and t[0].islower()}
    return {w: v for w, v in found.items() if " " in w or "-" in w or w not in small}


def got(spark, rows, excluded=None, iterations=100):
    df = spark.createDataFrame(rows, "row_id long, english string, japanese string")
    banned = None if excluded is None else spark.createDataFrame([(x,) for x in excluded], "word string")
    return {r.word: (r.english, r.kana) for r in induction.induce(df, banned, iterations).collect()}


CASES = [
    ("Frost", "フロスト"), ("Fall", "フォール"), ("Eye of Magnus", "マグナスの目"), ("Ring of Nullification", "無力化の指輪"), ("Daedric Shield of Nullification", "デイドラの盾(無力化)"),
    ("Urag gro-Shub", "ウラグ・グロ・シューブ"), ("Urag Gro-Shub", "ウラグ・グロ・シューブ"), ("Skaggi Scar-Face", "スカッジ・スカー・フェイス"), ("What dangers does the caravan face", "何"),
    ("Stone-Eye", "ストーン・アイ"), ("Adonato Leotelli", "アドナト・レオテリ"), ("Adonato Frost", "アドナト・フロスト"), ("Magnus Frost Fall", "マグナス・フロスト・フォール"), ("Frost Fall", "フロスト・フォールズ"),
    ("Urag Magnus", "ウラグ・マグナス"), ("", "ア"), ("Nothing", ""), ("A", "ア"), ("Iron Sword", "鉄の剣"), ("Old Man", "オールド・マン・テスト"), ("Man", "マン"), ("Old", "オールド"),
]


def test_known_cases(spark):
    rows = [(i, e, j) for i, (e, j) in enumerate(CASES)] + [(900, None, None), (901, None, "ア"), (902, "Null", None)]
    found = got(spark, rows, ["Fireball", "adonato"])
    assert found == walk(rows, ["Fireball", "adonato"])
    assert found["magnus"] == ("Magnus", "マグナス") and "face" not in found and "eye" not in found and "nullification" not in found and "adonato" not in found
    assert found["frost fall"] == ("Frost Fall", "フロスト・フォール")


def test_a_chain_is_followed_in_one_iteration_or_many(spark):
    """In rising order one walk resolves the whole chain, in falling order each iteration one link."""
    sound = "アイウエオカキクケコサシ"
    links = [(f"W{chr(97 + k)} W{chr(98 + k)} Zz", f"{sound[k]}ー・{sound[k + 1]}ー・カナ・カナ") for k in range(9)] + [("Wa", "アー"), ("Zz", "カナ・カナ")]
    up = [(i, e, j) for i, (e, j) in enumerate([links[-1], links[-2], *links[:-2]])]
    down = [(100 - i, e, j) for i, e, j in up]
    for rows in (up, down):
        for n in (1, 3, 100):
            assert got(spark, rows, iterations=n) == walk(rows, iterations=n)


@pytest.mark.parametrize("seed", range(2))
def test_random_corpora(spark, seed):
    """Few words with conflicting readings, so that order decides."""
    rng = random.Random(seed)
    words = ["Al", "Be", "Ce", "De", "El", "Fo", "Gu", "Hi"]
    sounds = {w: [f"{c}{d}" for d in "ーンス"] for w, c in zip(words, "アベセデエフグヒ")}
    rows = []
    for i in range(60):
        n = rng.choice([1, 2, 2, 3, 3, 4])
        w = [rng.choice(words) for _ in range(n)]
        said = rng.choice([" ", " ", "-"]).join(w) if rng.random() < 0.8 else " ".join(w).lower().capitalize()
        segs = [sounds[x][0] if rng.random() < 0.8 else rng.choice(sounds[x]) for x in w]
        if rng.random() < 0.2:
            segs = segs[:-1] or segs
        if rng.random() < 0.15:
            said, segs = f"{w[0]} of {' '.join(w[1:]) or 'Al'}", segs[1:] or segs
            rows.append((i, said, "・".join(segs) + "の" + rng.choice(["目", "メ"])))
            continue
        rows.append((i, said, "・".join(segs)))
    assert got(spark, rows) == walk(rows)


def test_origins(spark):
    rows = [(0, "Frost", "フロスト", "b", 1), (1, "Frost", "フロスト", "a", 0), (2, "Urag Frost", "ウラグ・フロスト", "a", 2), (3, "Ring of Bone", "骨の指輪", "a", 0)]
    corpus = spark.createDataFrame(rows, "row_id long, english string, japanese string, source string, tier int")
    aligned = spark.createDataFrame([("Frost", "氷", ["x"], 3), ("Mist", "ミスト", ["y"], 2), ("Ring", "リング", ["y"], 2), ("Bane", "ベイン", ["y"], 2)], "word string, kana string, sources array<string>, tier int")
    banned = spark.createDataFrame([("bane",)], "word string")
    found = {r.word: (r.kana, r.origin, r.sources, r.tier) for r in induction.dictionary(corpus, banned, aligned).collect()}
    assert found == {"frost": ("フロスト", "official", ["a", "b"], 0), "urag": ("ウラグ", "derived", [], None), "mist": ("ミスト", "sentence", ["y"], 2)}


def test_empty_corpus(spark):
    assert got(spark, []) == {}
