"""Names from known words, against a reading of one name at a time that is written apart from the operator."""

import random
import re

from glossweave.operators import names

EXACT = {"steel": "鋼", "boots": "ブーツ", "shoes": "靴", "heavy": "重", "heavy armor": "重装", "heavy armor of war": "戦装", "no": "いいえ", "armor": "鎧", "guard": "衛兵", "white": "ホワイト", "gold": "ゴールド", "x-ray": "透視"}
MEANING, KANA, GLOSSARY = {"guard": "番人", "plate": "板"}, {"otar": "オタール", "plate": "プレート"}, {"gloves": "手袋", "the mad": "狂", "mad": "狂", "glass": "ガラス"}
OWN = {"p": {"smp": "=", "boots": "長靴", "(odd)": "奇"}, "q": {"glove": "手"}}
COLOURS = set(names.COLOURS)


def lexicon(spark):
    t = lambda d, s: spark.createDataFrame([(w, j, s) for w, j in d.items()], "word string, japanese string, source string")
    return names.lexicon(exact=t(EXACT, "a"), meaning=t(MEANING, "b"), kana=t(KANA, ""), glossary=t(GLOSSARY, "c"))


def passes(w, own):
    return bool(re.fullmatch(r"-|\d+|[A-Z]|I{1,3}|IV|V|VI{1,3}|IX|X{1,3}", w)) or own.get(w.rstrip(",:;").lower()) == "="


def strip(w):
    return re.sub(r"(?i)'s$", "", w).rstrip(",:;")


def shared(w):
    for d in (EXACT, MEANING, KANA, GLOSSARY):
        if w.lower() in d:
            return d[w.lower()]


def single(w):
    return w[:-1] if len(w) > 3 and w[-1] in "sS" and w[-2] not in "sS" else None


def of_plugin(w, own):
    if len(w) > 2 and w[0] == "(" and w[-1] == ")" and (x := of_plugin(w[1:-1], own)):
        return f"({x})"
    for f in (strip(w), single(strip(w))):
        if f and f.lower() in own:
            return f if own[f.lower()] == "=" else own[f.lower()]


def of_all(w):
    if len(w) > 2 and w[0] == "(" and w[-1] == ")":
        x = of_all(w[1:-1])
        return x and f"({x})"
    c = strip(w)
    if shared(c):
        return shared(c)
    parts = [p for p in c.split("-") if p]
    if "-" in c and len(parts) > 1 and all(map(shared, parts)):
        return "".join(map(shared, parts))
    return single(c) and shared(single(c))


def word(w, own):
    return of_plugin(w, own) or of_all(w) or (w if passes(w, own) else None)


def brute(name, own):
    """(japanese or None, missing words)"""
    text, tag = name.strip(), ""
    if m := re.match(r"\[[^\]]*\]", text):
        tag, text = m[0] + " ", text[m.end() :].strip()
    ok = all(any(c.isupper() for c in w) or w.lower() in ("of", "the", "and", "in", "on", "at", "a", "an") or w == "-" or w.isdigit() or re.fullmatch(r"\d+(st|nd|rd|th)", w, re.I) for w in text.split(" ") if w)
    if not text or not ok:
        return None, []
    if (i := text.find(" of ")) > 0:
        after = re.sub("^(the|an|a) ", "", text[i + 4 :].strip(), flags=re.I).strip()
        if after and text[:i].strip():
            text = after + " " + text[:i].strip()
    words, links, link = [], [], "の"
    for t in text.split():
        if t.lower() == "and":
            link = "と"
        elif t.lower() != "the":
            links.append(" " if words and (t[0] == "(" or words[-1][-1] == ":" or passes(t, own) or passes(words[-1], own)) else link)
            words.append(t)
            link = "の"
    if not words:
        return None, []
    runs, i = [], 0
    while i < len(words):
        n = next((n for n in range(len(words) - i, 1, -1) if " ".join(words[i : i + n]).lower() in EXACT), 1)
        runs.append((i, n))
        i += n
    units, k = [], 0
    while k < len(runs):
        i, n = runs[k]
        if n == 1 and words[i].lower() in ("no", "not") and k + 1 < len(runs):
            units.append((i, *runs[k + 1], True))
            k += 2
        else:
            units.append((i, i, n, False))
            k += 1
    tail = len(units)
    while tail > 1 and not units[tail - 1][3] and units[tail - 1][2] == 1 and strip(words[units[tail - 1][1]]).lower() in COLOURS:
        tail -= 1
    missing, made = [], []
    for at, i, n, negated in units:
        x = EXACT[" ".join(words[i : i + n]).lower()] if n > 1 else word(words[i], own)
        if x is None:
            missing.append(words[i].rstrip(",:;"))
        made.append((at, f"（{x}なし）" if negated else x, negated))
    if missing:
        return None, missing
    pieces = made[:tail]
    if tail < len(units):
        pieces.append((made[tail][0], "（" + "・".join(x for _, x, _ in made[tail:]) + "）", True))
    out = pieces[0][1]
    for (_, _, apart), (at, x, mine) in zip(pieces, pieces[1:]):
        out += (" " if apart or mine else links[at]) + x
    return tag + out, []


def run(spark, wanted, own=True):
    rows = spark.createDataFrame(wanted, "plugin string, name string")
    mine = spark.createDataFrame([(p, w, j) for p, d in OWN.items() for w, j in d.items()], "plugin string, word string, japanese string") if own else None
    return {(r.plugin, r.name): (r.japanese, r.missing, r.detail) for r in names.translate(rows, lexicon(spark), own=mine, keys=("plugin",)).collect()}


CASES = {
    "Steel Boots": "鋼のブーツ", "Shoes and Boots": "靴とブーツ", "[E] Steel Boots": "[E] 鋼のブーツ", "Boots of Steel": "鋼のブーツ", "Boots of the Steel Guard": "鋼の衛兵のブーツ", "Steel Boots No Shoes": "鋼のブーツ （靴なし）",
    "Steel-Boots": "鋼ブーツ", "Boots (Steel)": "ブーツ (鋼)", "Heavy Armor": "重装", "Guard's Heavy Armor": "衛兵の重装", "Steel Boots White": "鋼のブーツ （ホワイト）", "Steel White Gold": "鋼 （ホワイト・ゴールド）", "White Gold": "ホワイト （ゴールド）",
    "White Boots": "ホワイトのブーツ", "No Heavy Armor": "（重装なし）", "Boots No": "ブーツのいいえ", "Boots 2": "ブーツ 2", "Boots - Steel": "ブーツ - 鋼", "Armor S": "鎧 S", "Armor IV": "鎧 IV", "Steel: Boots": "鋼 ブーツ", "Steel, Boots": "鋼のブーツ",
    "Armors": "鎧", "Glass": "ガラス", "Plate": "板", "Cloak Otar the Mad": None, "Boots of Otar the Mad": "オタールの狂のブーツ", "Steel Armor MIX": None, "X-Ray Boots": "透視のブーツ", "steel boots": None, "": None, "[E]": None,
}


def test_cases(spark):
    got = run(spark, [("", n) for n in CASES] + [("", "Steel Boots"), ("", None)], own=False)
    assert {n: j for (_, n), (j, *_) in got.items()} == CASES
    assert got["", "Cloak Otar the Mad"][1] == ["Cloak"] and got["", "Steel Armor MIX"][1] == ["MIX"] and got["", "steel boots"][1] == []
    assert got["", "Guard's Heavy Armor"][2] == '"Guard\'s"→"衛兵"(①完全一致[a]) + "Heavy Armor"→"重装"(①完全一致[a])'
    assert got["", "Otar the Mad" if ("", "Otar the Mad") in got else "Boots of Otar the Mad"][2].startswith('"Otar"→"オタール"(③音訳) + "Mad"→"狂"(全体用語集')


def test_glossary_of_the_plugin_comes_first(spark):
    got = run(spark, [("p", "Steel Boots"), ("q", "Steel Boots"), ("p", "Boots SMP"), ("q", "Boots SMP"), ("q", "Steel Gloves"), ("p", "(ODD) Boots")])
    assert got["p", "Steel Boots"][0] == "鋼の長靴" and got["q", "Steel Boots"][0] == "鋼のブーツ" and got["p", "Boots SMP"][0] == "長靴 SMP" and got["q", "Boots SMP"][:2] == (None, ["SMP"])
    assert got["q", "Steel Gloves"][0] == "鋼の手"


def test_random_names(spark):
    rng = random.Random(7)
    words = ["Steel", "Boots", "Heavy", "Armor", "of", "War", "No", "Not", "White", "Gold", "and", "the", "(Steel)", "Guard's", "Plate:", "Gloves,", "X-Ray", "Heavy-Armor", "-", "12", "B", "VI", "Qux", "Shoes", "Glass", "SMP", "Red"]
    wanted = {(rng.choice("pq"), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))) for _ in range(500)}
    got = run(spark, sorted(wanted))
    assert {k: (j, m) for k, (j, m, _) in got.items()} == {(p, n): brute(n, OWN[p]) for p, n in wanted}


def test_empty(spark):
    assert run(spark, []) == {}
