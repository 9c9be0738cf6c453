"""Text predicates and transforms as Column expressions.

Every function takes and returns Columns, stays inside code generation and treats null as blank.
Patterns are ordinary Java regular expressions; white space includes the Unicode separators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------
JAPANESE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
KATAKANA = r"[\x{30A0}-\x{30FF}]"
SPACE = r"[\s\p{Z}]"
TAG = "<[^>]*>"
SMALL_WORDS = ["of", "the", "and", "in", "on", "at", "a", "an"]
PLACEHOLDERS = ["xxx", "todo", "tbd", "n/a", "test", "placeholder"]
ASSET_EXTENSIONS = ["nif", "dds", "wav", "xwm", "hkx", "pex", "swf", "bik", "tga"]
ICON_FONTS = ["Iconographia"]
RETRIEVAL_STOP_WORDS = ["the", "and", "for", "with", "this", "that", "from", "are", "was", "were", "well"]
NAME_STOP_WORDS = (
    "a an the of in on at is are was were this that and or for with from to get what you your it its "
    "do does did not no yes if but so as by be been has have had"
).split()
PARTICLES = "のをがにへとでは"
# -----------------------------------------------------------------------------------------


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def trim(c: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.regexp_replace(blank(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return trim(c) == ""


def words(c: Column) -> Column:
    """The non-empty parts between plain spaces."""
    return F.filter(F.split(blank(c), " "), lambda w: w != "")


def contains_japanese(c: Column) -> Column:
    return blank(c).rlike(JAPANESE)


def is_translatable_english(c: Column) -> Column:
    return ~contains_japanese(c) & blank(c).rlike(r"\p{L}")


def looks_like_name(c: Column) -> Column:
    """Every word is capitalised, a small word, a dash, a number or an ordinal; true when there is none."""
    return F.forall(words(c), lambda w: w.rlike(r"\p{Lu}") | F.lower(w).isin(SMALL_WORDS) | (w == "-") | w.rlike(r"^\p{Nd}+$") | w.rlike(r"(?i)^\d+(st|nd|rd|th)$"))


def is_markup_only(c: Column) -> Column:
    seen = trim(F.regexp_replace(blank(c), TAG, ""))
    icon = F.lit(False)
    for font in ICON_FONTS:
        icon = icon | F.lower(blank(c)).contains(font.lower())
    return is_blank(c) | (blank(c).contains("<") & (~seen.rlike(r"\p{L}") | (icon & (F.char_length(seen) <= 1))))


def looks_like_identifier(c: Column) -> Column:
    """No white space, four characters or more, and camel case, letters with digits, a run of capitals before a small letter, or upper snake case."""
    t = trim(c)
    mixed = t.rlike(r"\p{L}") & t.rlike(r"\p{Nd}")
    return (F.char_length(t) >= 4) & ~t.rlike(SPACE) & (t.rlike(r"\p{Ll}\p{Lu}") | mixed | t.rlike(r"\p{Lu}{2,}\p{Ll}") | (t.contains("_") & t.rlike(r"^[\p{Lu}\p{Nd}_]+$")))


def looks_like_audio_template(c: Column) -> Column:
    return blank(c).rlike(r"(?i)^\s*AudioTemplate")


def looks_like_do_not_delete(c: Column) -> Column:
    return blank(c).rlike(r"(?i)^\s*Do Not Delete")


def looks_like_version_note(c: Column) -> Column:
    return blank(c).rlike(r"\b\d+\.\d+(\.\d+)?\b")


def looks_like_internal_fx(c: Column) -> Column:
    return blank(c).rlike(r"(?i) fx\s*$")


def looks_like_temp(c: Column) -> Column:
    return blank(c).rlike(r"(?i)(?<![A-Za-z])temp(?![A-Za-z])")


def is_placeholder(c: Column) -> Column:
    return F.lower(trim(c)).isin(PLACEHOLDERS)


def looks_like_acronym(c: Column) -> Column:
    t = trim(c)
    return t.rlike(r"^\p{Lu}{3,}$") & ~t.rlike("[AEIOU]")


def looks_like_interface_key(c: Column) -> Column:
    return trim(c).rlike(r"^\$[\p{L}\p{Nd}_]+$")


def is_asset_path(c: Column) -> Column:
    t = trim(c)
    return (t != "") & ~t.rlike(SPACE) & (t.rlike(rf"(?i)\.({'|'.join(ASSET_EXTENSIONS)})$") | t.contains("\\"))


#: The exclusion rules that hold for any record, in order; the first that holds gives the reason.
TEXT_REASONS = [
    ("markup", is_markup_only),
    ("asset_path", is_asset_path),
    ("identifier", looks_like_identifier),
    ("audio_template", looks_like_audio_template),
    ("do_not_delete", looks_like_do_not_delete),
    ("version_note", looks_like_version_note),
    ("internal_fx", looks_like_internal_fx),
    ("temp", looks_like_temp),
    ("placeholder", is_placeholder),
    ("acronym", looks_like_acronym),
    ("interface_key", looks_like_interface_key),
]


def exclusion_reason(text: Column, record_type: Column | None = None, hidden: Column | None = None) -> Column:
    """The first exclusion rule that holds, or null. Version notes count for quest names and temp marks for
    names only, when the record type is known; ``hidden`` comes right after markup."""
    out = F.when(is_markup_only(text), "markup")
    if hidden is not None:
        out = out.when(hidden, "hidden_record")
    for name, rule in TEXT_REASONS[1:]:
        test = rule(text)
        if record_type is not None and name == "version_note":
            test = test & (record_type == "QUST FULL")
        if record_type is not None and name == "temp":
            test = test & record_type.endswith(" FULL")
        out = out.when(test, name)
    return out


def ini_exclusion_reason(text: Column) -> Column:
    """Why the text of a name line is not offered, or null."""
    return (
        F.when(contains_japanese(text), "AlreadyJapanese")
        .when(~is_translatable_english(text), "NoLetters")
        .when(is_markup_only(text), "MarkupOnly")
        .when(looks_like_interface_key(text), "InterfaceKeyReference")
        .when(is_asset_path(text), "AssetPath")
        .when(is_placeholder(text), "PlaceholderToken")
        .when(looks_like_acronym(text), "NonWordAcronym")
    )


def quality_class(japanese: Column) -> Column:
    """How much half-width alphanumeric text a translation still holds."""
    count = lambda c: F.regexp_count(c, F.lit("[A-Za-z0-9]"))
    text = blank(japanese)
    return (
        F.when(~contains_japanese(text), "NoJapanese")
        .when(count(text) == 0, "AllJapanese")
        .when(count(text) * 2 >= F.char_length(text), "ContainsMostOfAlphaNumeric")
        .when(count(F.regexp_replace(text, TAG, "")) > 0, "ContainsPartsOfAlphaNumeric")
        .otherwise("ContainsTagAlphaNumeric")
    )


def is_mineable_english(c: Column) -> Column:
    """Short, name-like, plain ASCII words that split into modifier and head."""
    plain = F.forall(words(c), lambda w: w.rlike("^[A-Za-z'-]*$"))
    return (F.char_length(blank(c)).between(1, 40)) & ~blank(c).rlike(r'[<>%\[\]()",.!?:;]') & looks_like_name(c) & plain & split_head(c).isNotNull()


def looks_like_proper_noun(c: Column) -> Column:
    """One to three capitalised words without stop words or sentence punctuation."""
    w = words(c)

    def named(x: Column) -> Column:
        alpha = F.regexp_replace(x, r"\P{L}", "")
        return (alpha != "") & ~F.lower(alpha).isin(NAME_STOP_WORDS) & alpha.rlike(r"^\p{Lu}")

    return ~blank(c).rlike("[!?.,;:]") & F.size(w).between(1, 3) & F.forall(w, named)


def is_pure_katakana(c: Column) -> Column:
    return blank(c).rlike(f"^{KATAKANA}+$")


def is_plain_phrase(c: Column) -> Column:
    return trim(c).rlike("^[A-Za-z][A-Za-z' -]*$")


def is_pass_through(c: Column) -> Column:
    """Tokens that stay as they are: a dash, a number, one capital, a Roman numeral."""
    return blank(c).rlike(r"^(-|\p{Nd}+|\p{Lu}|I{1,3}|IV|V|VI{1,3}|IX|X{1,3})$")


def tags(c: Column) -> Column:
    return F.regexp_extract_all(blank(c), F.lit(TAG), 0)


def same_tags(a: Column, b: Column) -> Column:
    """Equal multisets of tags."""
    return F.array_sort(tags(a)) == F.array_sort(tags(b))


def same_skeleton(a: Column, b: Column) -> Column:
    """Tags equal in order and case; the rest equal apart from case and outer white space."""
    rest = lambda c: F.upper(trim(F.regexp_replace(blank(c), TAG, "")))
    return (tags(a) == tags(b)) & (rest(a) == rest(b))


def escape_tsv(c: Column) -> Column:
    out = F.replace(blank(c), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\t"), F.lit("\\t"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit("\r"), F.lit(""))


def unescape_tsv(c: Column) -> Column:
    """One left-to-right pass: the text is cut at doubled backslashes, and the parts are unescaped by themselves; unknown escapes stay."""
    parts = F.split(blank(c), r"\\\\")
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def preview(c: Column, limit: int = 40) -> Column:
    flat = F.replace(F.replace(blank(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    return F.when(F.char_length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def safe_folder(c: Column) -> Column:
    return F.regexp_replace(blank(c), r'[<>:"/\\|?*\x00-\x1f]', "_")


def parse_form_id(c: Column) -> Column:
    """HEX|Plugin as struct(local_id, mod): the last six hex digits count; null if malformed."""
    hex_part, mod = F.substring_index(c, "|", 1), F.substring_index(c, "|", -1)
    ok = c.contains("|") & hex_part.rlike("^(0[xX])?[0-9A-Fa-f]{1,8}$")
    digits = F.regexp_replace(hex_part, "^0[xX]", "")
    return F.when(ok, F.struct(F.conv(F.right(digits, F.lit(6)), 16, 10).cast("int").alias("local_id"), mod.alias("mod")))


def retrieval_tokens(c: Column) -> Column:
    parts = F.transform(F.split(blank(c), "[^A-Za-z']+"), F.lower)
    return F.array_distinct(F.filter(parts, lambda w: (F.char_length(w) > 2) & ~w.isin(RETRIEVAL_STOP_WORDS)))


def ngrams(tokens: Column, longest: int = 5) -> Column:
    """All runs of 1 to ``longest`` tokens, joined by spaces."""
    size = F.size(tokens)

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1)))
        run = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(size >= n, run).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def phrase_tokens(c: Column) -> Column:
    """Words after markup is stripped, without numbers."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(blank(c), TAG, " "), F.lit(r"[\p{L}\p{Nd}'-]+"), 0), lambda w: ~w.rlike(r"^\p{Nd}+$"))


def split_head(c: Column) -> Column:
    """struct(head, modifier) of a compound name: "X of Y" (Y of two words at most, article dropped), or the last
    of two or three words; null for others and for conjunctions and negations."""
    t = trim(c)
    head_of = trim(F.substring_index(t, " of ", 1))
    rest = trim(F.regexp_extract(t, r"^.*? of (?:(?i:the|an|a) )?\s*(.*)$", 1))
    w = words(t)
    of_form = (F.locate(" of ", t) > 1) & ~head_of.contains(" ") & (head_of != "") & (rest != "") & (F.size(words(rest)) <= 2)
    bad = F.lower(t).contains(" and ") | F.lower(t).contains(" or ") | t.startswith("No ") | t.startswith("Not ")
    last = F.struct(F.element_at(w, -1).alias("head"), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1))), " ").alias("modifier"))
    return F.when(bad, F.lit(None)).when(of_form, F.struct(head_of.alias("head"), rest.alias("modifier"))).when(F.size(w).between(2, 3), last)


def trailing_katakana(c: Column) -> Column:
    """The run of two or more katakana at the end, unless it is the whole text; else empty."""
    run = F.regexp_extract(blank(c), r"[\x{30A0}-\x{30FF}]+$", 0)
    return F.when((F.char_length(run) >= 2) & (F.char_length(run) < F.char_length(blank(c))), run).otherwise("")


def flatten_lines(c: Column) -> Column:
    return F.replace(blank(c), F.lit("\n"), F.lit("<SJPTS_BR>"))


def restore_lines(c: Column) -> Column:
    return F.regexp_replace(blank(c), r"(?i)\s*<SJPTS_BR>\s*", "\n")


def percent(part: Column, whole: Column, empty: float = 100.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.lit(100.0) * part / whole)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(blank(c), "UTF-16LE")) / 2).cast("long")


def insert_folder(path: Column, folder: str = "zzz_SJPTS") -> Column:
    """``folder`` as the second element of a path."""
    return F.array_join(F.array_insert(F.split(path, "/"), 2, F.lit(folder)), "/")


def normal_target(c: Column) -> Column:
    """plugin|0x000ABC as plugin|ABC; a bare name as @name."""
    plugin, number = F.lower(trim(F.substring_index(c, "|", 1))), trim(F.substring_index(c, "|", -1))
    digits = F.upper(F.regexp_replace(number, "^(0[xX])?0*", ""))
    return F.when(c.contains("|"), F.concat(plugin, F.lit("|"), F.when(digits == "", "0").otherwise(digits))).otherwise(F.concat(F.lit("@"), F.lower(trim(c))))


def to_kana(c: Column) -> Column:
    """A fixed letter-by-letter stand-in for a Japanese reading, for tables without Japanese text."""
    return F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz ", "アブクデエフグヒイジケルムノオパキラストウヴワズヤゼ・")
