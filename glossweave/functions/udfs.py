"""Functions whose logic is a sequential scan: vectorised Python over Arrow batches, never in a hot path
before the distinct values are taken."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# --- Fixed values: spelling to katakana ---------------------------------------------------
DIGRAPHS = {
    "tion": "ション", "sion": "ション", "augh": "オー", "ough": "オー", "eigh": "エイ", "ight": "アイト", "tch": "ッチ", "dge": "ッジ",
    "ph": "フ", "th": "ス", "sh": "シュ", "ch": "チ", "wh": "ホ", "ck": "ック", "ng": "ング", "qu": "ク", "ee": "イー", "ea": "イー",
    "oo": "ウー", "ou": "アウ", "ow": "アウ", "oi": "オイ", "oy": "オイ", "ai": "エイ", "ay": "エイ", "au": "オー", "aw": "オー", "ie": "アイ",
}
ROWS = {
    "k": "カ キ ク ケ コ", "g": "ガ ギ グ ゲ ゴ", "s": "サ シ ス セ ソ", "z": "ザ ジ ズ ゼ ゾ", "t": "タ チ ツ テ ト", "d": "ダ ジ ド デ ド",
    "n": "ナ ニ ヌ ネ ノ", "h": "ハ ヒ フ ヘ ホ", "f": "ファ フィ フ フェ フォ", "b": "バ ビ ブ ベ ボ", "p": "パ ピ プ ペ ポ", "m": "マ ミ ム メ モ",
    "y": "ヤ イ ユ イェ ヨ", "r": "ラ リ ル レ ロ", "l": "ラ リ ル レ ロ", "v": "ヴァ ヴィ ヴ ヴェ ヴォ", "w": "ワ ウィ ウ ウェ ウォ",
    "j": "ジャ ジ ジュ ジェ ジョ", "x": "ザ ジ ズ ゼ ゾ", "c": "カ シ ク セ コ",
}
SOFT_C = "サ シ ス セ ソ"
VOWELS = dict(zip("aiueo", "アイウエオ"))
CODAS = dict(k="ク", g="グ", s="ス", z="ズ", t="ト", d="ド", n="ン", h="フ", f="フ", b="ブ", p="プ", m="ム", r="ル", l="ル", v="ヴ", j="ジ", x="クス", c="ク")
INITIAL_SOUNDS = {
    "A": "アエオ", "B": "バビブベボヴ", "C": "カキクケコサシスセソチシャ", "D": "ダヂヅデド", "E": "エイア", "F": "ファフィフフェフォ", "G": "ガギグゲゴジ",
    "H": "ハヒフヘホ", "I": "イアエ", "J": "ジャジジュジェジョヤ", "K": "カキクケコ", "L": "ラリルレロ", "M": "マミムメモ", "N": "ナニヌネノ", "O": "オア",
    "P": "パピプペポ", "Q": "クキ", "R": "ラリルレロ", "S": "サシスセソシャシュショ", "T": "タチツテトティ", "U": "ウアオ", "V": "ヴバビブベボ",
    "W": "ワウヲヴ", "X": "ザエ", "Y": "ヤユヨイ", "Z": "ザジズゼゾ",
}
MIN_LENGTH_RATIO, MAX_LENGTH_RATIO, MIN_SIMILARITY = 0.45, 1.15, 0.20
# --------------------------------------------------------------------------------------------


def _sound_table() -> dict[str, str]:
    """Every spelling unit with its kana: digraphs, consonant with vowel, soft c, doubled consonants, codas, vowels."""
    out = dict(VOWELS)
    for c, row in ROWS.items():
        sounds = row.split(" ")
        out[c] = CODAS.get(c, sounds[2])
        for v, s in zip("aiueo", sounds):
            out[c + v] = s
    soft = SOFT_C.split(" ")
    out["ci"], out["ce"] = soft[1], soft[3]
    return out


_SOUNDS = _sound_table()
_DOUBLED = "".join(c for c in CODAS if c != "n")
_UNIT = re.compile("|".join([*DIGRAPHS, *(f"[{c}][aiueo]" for c in ROWS), rf"([{_DOUBLED}])(?=\1)", "[a-z]"]))


def kana_word(word: str) -> str:
    """One word by the spelling rules; a word without letters stays as it is."""
    letters = "".join(filter(str.isalpha, word)).lower()
    if not letters:
        return word
    if len(letters) > 3 and letters[-1] == "e" and letters[-2] not in VOWELS:
        letters = letters[:-1]  # silent e
    out = "".join("ッ" if m[1] else DIGRAPHS.get(m[0]) or _SOUNDS.get(m[0], "") for m in _UNIT.finditer(letters))
    return out or word


def kana_name(name: str) -> str:
    return "・".join(kana_word(w) for w in name.replace("\t", " ").split(" ") if w)


@pandas_udf(T.StringType())
def transliterate(names: pd.Series) -> pd.Series:
    return names.fillna("").map({n: kana_name(n) for n in names.dropna().unique()}).fillna("")


def plausible(word: Column, kana: Column) -> Column:
    """Whether a katakana run may render an English word: initial sound, length ratio, phonetic likeness."""
    starts = F.create_map(*[F.lit(x) for kv in INITIAL_SOUNDS.items() for x in kv])
    allowed = F.coalesce(F.try_element_at(starts, F.upper(F.substring(word, 1, 1))), F.lit(""))
    letters = F.regexp_count(word, F.lit("[A-Za-z]"))
    ratio = F.char_length(kana) / letters
    guess = transliterate(word)
    alike = F.lit(1.0) - F.levenshtein(guess, kana) / F.greatest(F.char_length(guess), F.char_length(kana))
    return (kana != "") & allowed.contains(F.substring(kana, 1, 1)) & (letters > 0) & ratio.between(MIN_LENGTH_RATIO, MAX_LENGTH_RATIO) & (alike >= MIN_SIMILARITY)
