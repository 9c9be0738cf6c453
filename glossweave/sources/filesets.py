"""Sets of text files that are written as a whole, and the formats that are made of lines.

A format is a table of lines: ``path`` (below the root), columns that order the lines of a file, and ``line``. Tasks write each
file's lines in order to a staging folder beside the root; when all of them are there the driver gives the files
their names and puts the new root in the place of the old one. A job that fails leaves the old root as it was. No file is
gathered in a row: a file is a sorted run of one task.

Defined results: an empty table gives an empty root; null cells are empty; paths must not be empty and use ``/``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# --- Fixed values: headers and texts of the formats ------------------------------------------------
BOM = "﻿"
DERIVED = {"derived_transliteration_dict.tsv": "English\tJapanese\tOrigin\tSource", "derived_meaning_dict.tsv": "English\tJapanese\tKind\tSource"}
AUTO_RESOLVE = "Plugin TotalCount AutoResolvedCount RemainingCount AutoResolvedRatio(%) TotalChars AutoResolvedChars RemainingChars AutoResolvedCharsRatio(%) SampleRemaining".split()
ACTIVE = "Index FileName HasTranslatableContent".split()
REVIEW = "## 要レビュー（DSD翻訳は適用されているが、原文が変わった可能性あり）"
CANDIDATE_HEAD = ["# JP翻訳候補リスト", "# プロファイル: {profile}", "# 生成日時: {time}", "# 対象候補数: {n}", "# 対象範囲: FULL(名前)のみ。DESC/会話文等は今後拡張予定", ""]
INDEX_HEAD = ["# Translation 一括生成インデックス（候補数の多い順）", "# 生成日時: {time}", "# プラグイン数: {plugins}, 候補総数: {total}, 自動解決: {resolved}", ""]
JSON_NAME = "SKSE/Plugins/DynamicStringDistributor/{plugin}/zzz_SJPTS_{stamp}.json"
# ---------------------------------------------------------------------------------------------------


def write_file_set(lines: DataFrame, root: str, order: Sequence[str], bom: bool = True) -> list[str]:
    """Write ``lines`` (path, order..., line) as files below ``root``, which is replaced as a whole. Returns the paths.

    ``root`` is replaced by two renames of the file system; what a stopped writer leaves beside it is not read by anyone.
    """
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    base = root.rstrip("/")
    fs, tag = at(base).getFileSystem(conf), uuid.uuid4().hex
    staging, new, old = f"{base}.staging-{tag}", f"{base}.new-{tag}", f"{base}.old-{tag}"
    first = F.row_number().over(Window.partitionBy("path").orderBy(*order)) == 1
    rows = lines.select("path", *order, F.coalesce("line", F.lit("")).alias("line"))
    if bom:
        rows = rows.withColumn("line", F.when(first, F.concat(F.lit(BOM), "line")).otherwise(F.col("line")))
    try:
        sorted_ = rows.repartition("path").sortWithinPartitions("path", *order)
        sorted_.select(F.col("line").alias("value"), F.col("path").alias("_path")).write.partitionBy("_path").text(staging)
        fs.mkdirs(at(new))
        names = []
        for folder in fs.listStatus(at(staging)):  # one entry a file of the set
            name = folder.getPath().getName()
            if not name.startswith("_path="):
                continue
            path = unquote(name.removeprefix("_path="))
            parts = [f.getPath() for f in fs.listStatus(folder.getPath())]
            if len(parts) != 1:
                raise RuntimeError(f"{path} was written in {len(parts)} parts")
            target = at(f"{new}/{path}")
            fs.mkdirs(target.getParent())
            if not fs.rename(parts[0], target):
                raise RuntimeError(f"could not name {path}")
            names.append(path)
        had = fs.exists(at(base))
        if had and not fs.rename(at(base), at(old)):
            raise RuntimeError(f"could not move {base} away")
        if not fs.rename(at(new), at(base)):
            if had:
                fs.rename(at(old), at(base))
            raise RuntimeError(f"could not publish {base}")
        return sorted(names)
    finally:
        for p in (staging, new, old):
            fs.delete(at(p), True)


def _lines(df: DataFrame, path: Column, section: int, line: Column, *order: Column) -> DataFrame:
    """Lines of one section of a format: path, section, a, b, c, line. Missing order columns are empty."""
    keys = [*order, *[F.lit(None)] * (3 - len(order))]
    return df.select(path.alias("path"), F.lit(section).alias("section"), keys[0].cast("long").alias("a"), keys[1].cast("string").alias("b"), keys[2].cast("long").alias("c"), line.alias("line"))


ORDER = ("section", "a", "b", "c")


def _fixed(df: DataFrame, path: str, section: int, texts: list[Column | str]) -> DataFrame:
    one = df.sparkSession.range(1).select(F.posexplode(F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])).alias("a", "line"))
    return _lines(one, F.lit(path), section, F.col("line"), F.col("a"))


def tsv(df: DataFrame, path: Column, header: str, columns: Sequence[str], *order: Column, escape: bool = True) -> DataFrame:
    """A header and one line a row, for each path; ``order`` as in ``ORDER`` after the section."""
    cell = lambda c: X.escape_tsv(X.blank(F.col(c).cast("string"))) if escape else X.blank(F.col(c).cast("string"))
    rows = _lines(df, path, 1, F.concat_ws("\t", *map(cell, columns)), *order)
    return _lines(rows.select("path").distinct(), F.col("path"), 0, F.lit(header)).unionByName(rows)


def candidate_list(rows: DataFrame, review: DataFrame, profile: str, time: str, path: str = "candidates.txt") -> DataFrame:
    """The readable list: rows (plugin, form_id, type, text) by plugins of most rows, then review lines (position, line), if there are any."""
    total = rows.count()
    per = rows.groupBy("plugin").agg(F.count(F.lit(1)).alias("n"))
    head = _fixed(rows, path, 0, [h.format(profile=profile, time=time, n=total) for h in CANDIDATE_HEAD])
    n, plugin = -F.col("n"), F.col("plugin")
    titles = _lines(per, F.lit(path), 1, F.concat(F.lit("## "), plugin, F.lit(" ("), F.col("n").cast("string"), F.lit("件)")), n, plugin, F.lit(0))
    number = F.row_number().over(Window.partitionBy("plugin").orderBy("form_id", "type", "text"))
    body = _lines(rows.join(per, "plugin").withColumn("k", number), F.lit(path), 1, F.concat(F.lit("  "), "form_id", F.lit("\t["), "type", F.lit("]\t"), "text"), n, plugin, F.col("k"))
    gaps = _lines(per, F.lit(path), 1, F.lit(""), n, plugin, F.lit(1 << 62))
    notes = _lines(review, F.lit(path), 3, F.concat(F.lit("  "), "line"), F.col("position"))
    title = _lines(review.select(F.lit(REVIEW).alias("line")).distinct(), F.lit(path), 2, F.col("line"))
    return head.unionByName(titles).unionByName(body).unionByName(gaps).unionByName(title).unionByName(notes)


def json_lines(entries: DataFrame, stamp: str, fields: Sequence[str] = ("form_id", "editor_id", "index", "type", "original", "string", "status"), name: str = JSON_NAME) -> DataFrame:
    """One indented JSON array a plugin, of entries (plugin, row_id, fields...) by row id; null fields are left out, other scripts stay as they are.
    ``stamp``: the time in the files' names, yyyyMMddHHmmss."""
    before, after = name.replace("{stamp}", stamp).split("{plugin}")
    path = F.concat(F.lit(before), "plugin", F.lit(after))
    literal = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    own = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.concat(F.lit(f'    "{f}": '), literal(F.col(f)))) for f in fields]))
    by = Window.partitionBy("plugin")
    rows = entries.withColumn("k", F.row_number().over(by.orderBy("row_id"))).withColumn("last", F.count(F.lit(1)).over(by) == F.col("k"))
    text = F.concat(F.lit("  {\n"), F.array_join(own, ",\n"), F.when(F.col("last"), "\n  }").otherwise("\n  },"))
    ends = entries.select("plugin").distinct()
    return _lines(ends, path, 0, F.lit("[")).unionByName(_lines(rows, path, 1, text, F.col("k"))).unionByName(_lines(ends, path, 2, F.lit("]")))


def translation_index(per: DataFrame, time: str, path: str = "translation_index.txt") -> DataFrame:
    """Plugins (plugin, total, resolved, dir) by their number of candidates."""
    sums = per.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("r")).first()
    head = _fixed(per, path, 0, [h.format(time=time, plugins=sums["n"], total=sums["t"], resolved=sums["r"]) for h in INDEX_HEAD])
    line = F.format_string("%6d件（自動解決%5d件）\t%s\t%s", "total", "resolved", "plugin", "dir")
    return head.unionByName(_lines(per, F.lit(path), 1, line, -F.col("total"), F.col("plugin")))


def auto_resolve(per: DataFrame, path: str = "auto_resolve_by_plugin.tsv") -> DataFrame:
    """Plugins (plugin, total, resolved, resolved_chars, remaining_chars, samples) by the share that was resolved, least first."""
    ratio = X.percent(F.col("resolved"), F.col("total"))
    chars = F.col("resolved_chars") + F.col("remaining_chars")
    char_ratio = X.percent(F.col("resolved_chars"), chars)
    one = lambda c: F.format_string("%.1f", c)
    cells = ["plugin", "total", "resolved", F.col("total") - F.col("resolved"), one(ratio), chars, "resolved_chars", "remaining_chars", one(char_ratio), X.escape_tsv(F.array_join(F.transform("samples", X.preview), " / "))]
    line = F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells])
    rows = _lines(per, F.lit(path), 1, line, F.round(ratio * 1_000_000), F.col("plugin"))
    return _fixed(per, path, 0, ["\t".join(AUTO_RESOLVE)]).unionByName(rows)


def derived_tables(spelled: DataFrame, meanings: DataFrame) -> DataFrame:
    """The two dictionaries (english, japanese, origin or kind, source), sorted."""
    first, second = DERIVED
    a = _lines(spelled, F.lit(first), 1, F.concat_ws("\t", "english", "japanese", "origin", X.blank(F.col("source"))), F.lit(0), F.concat(F.lower("english"), F.lit("\x00"), "english"))
    b = _lines(meanings, F.lit(second), 1, F.concat_ws("\t", "english", "japanese", "kind", X.blank(F.col("source"))), F.lit(0), F.concat("kind", F.lit("\x00"), F.lower("english"), F.lit("\x00"), "english"))
    heads = _fixed(spelled, first, 0, [DERIVED[first]]).unionByName(_fixed(spelled, second, 0, [DERIVED[second]]))
    return heads.unionByName(a).unionByName(b)


def active_plugins(plugins: DataFrame, candidates: DataFrame, path: str = "active_plugins.tsv") -> DataFrame:
    """Plugins (pos, plugin) in order with whether they have candidates (case ignored)."""
    some = candidates.select(F.lower("plugin").alias("_k")).distinct().withColumn("_has", F.lit(True))
    rows = plugins.join(some, F.lower("plugin") == F.col("_k"), "left")
    line = F.concat_ws("\t", F.col("pos").cast("string"), "plugin", F.when(F.col("_has"), "True").otherwise("False"))
    return _fixed(plugins, path, 0, ["\t".join(ACTIVE)]).unionByName(_lines(rows, F.lit(path), 1, line, F.col("pos")))


def glossary_template(merged: DataFrame, notes: Sequence[str], columns: Sequence[str], path: Column) -> DataFrame:
    """A glossary for people to fill in: notes, the column names as a note, then merged rows, those still blocked by count, then retired ones.
    ``columns``: the word, what was entered, a count and an example."""
    word, human, count, example = columns
    paths = merged.select(path.alias("path")).distinct()
    texts = F.posexplode(F.array(*[F.lit(f"# {n}".rstrip()) for n in notes], F.lit("# English\tJapanese\tRemaining\tExample"))).alias("a", "line")
    head = _lines(paths.select("path", texts), F.col("path"), 0, F.col("line"), F.col("a"))
    line = F.concat_ws("\t", word, X.blank(F.col(human)), F.col(count).cast("string"), X.blank(F.col(example)))
    return head.unionByName(_lines(merged, path, 1, line, -F.col(count), F.col(word)))
