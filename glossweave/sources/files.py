"""Readers of the file formats: tab-separated tables, JSON, XML, INI, word lists and plugin lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.iface import last_wins, sections

# --- Fixed values: column orders of the positional tables -------------------------------------
CANDIDATE = "FormId WinningPlugin RecordType CurrentText Index EditorId Context StaleOriginal StaleTranslation Warning CrossModPrecedentJapanese CrossModPrecedentNeedsReview DsdCoveredJapanese DsdCoveredNotes SourcePath SourceFilter SourceLine Inactive Excluded".split()
CANDIDATE_LEAST, CANDIDATE_INTS = 4, ("Index", "SourceLine")
CORPUS, CORPUS_LEAST = "English Japanese Source SourceKind DsdType".split(), 4
TRANSLATIONS, TRANSLATIONS_LEAST = "FormId WinningPlugin RecordType EnglishText Japanese Notes Index EditorId TranslationCheck".split(), 6
COVERAGE = "Plugin TotalCount TranslatedCount UntranslatedCount Ratio TotalChars TranslatedChars UntranslatedChars CharsRatio SampleUntranslated".split()
DSD_SCHEMA = "editor_id string, form_id string, index int, type string, original string, string string, status string, _bad string"
#: Bytes 80 to 9F of Windows-1252, which ISO-8859-1 reads as controls.
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
# ----------------------------------------------------------------------------------------------


def numbered(raw: DataFrame, value: str = "value") -> DataFrame:
    """file, line_no, line of a scan of text lines with file, block (where a byte range of the file starts) and its line.

    Files are read in byte ranges by many tasks. A range's lines are counted, the ranges of a file are summed up in their order (a row a
    range), and a line's number is the sum before its range and its place in it. Places come from the scan's own row
    ids, which rise within a range.
    """
    ids = raw.withColumn("id", F.monotonically_increasing_id())
    per = ids.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    out = ids.join(per, ["file", "block"]).withColumn("line_no", (F.col("id") + F.col("shift") + 1).cast("long"))
    line = F.when(F.col("line_no") == 1, F.regexp_replace(value, "^\ufeff", "")).otherwise(F.col(value))
    return out.select("file", "line_no", line.alias("line"))


def lines(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """file, line_no (in file order), line: CR, LF or CRLF ends, a mark at the start skipped. Large files are read in byte ranges."""
    raw = spark.read.options(**options).text(path)
    return numbered(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))


def positional(spark: SparkSession, path: str | list[str], columns: Sequence[str], least: int, ints: Sequence[str] = ()) -> DataFrame:
    """A positional table with a header: blank and short rows are dropped, missing trailing columns are empty or 0."""
    rows = lines(spark, path).where("line_no > 1 and trim(line) <> ''").withColumn("c", F.split("line", "\t")).where(F.size("c") >= least)
    cell = lambda i, n: F.coalesce(F.try_to_number(F.get("c", F.lit(i)), F.lit("999999999")).cast("int"), F.lit(0)) if n in ints else X.unescape_tsv(F.get("c", F.lit(i)))
    return rows.select("file", "line_no", *[cell(i, n).alias(n) for i, n in enumerate(columns)])


def checked(spark: SparkSession, paths: list[str], columns: Sequence[str], least: int, ints: Sequence[str] = ()) -> DataFrame:
    """The rows of ``positional`` and what could not be read, in one scan: ``error`` is null for good rows, else says why a row or a whole file
    is set aside (with the text as it stands in ``raw``). Files that are not there are rows as well."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    gone = [p for p in paths if not there(p)]
    none = T.StructType([T.StructField(n, T.StringType() if n not in ints else T.IntegerType()) for n in columns])
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("line_no", T.LongType()), *none.fields, T.StructField("error", T.StringType()), T.StructField("raw", T.StringType())])
    out = spark.createDataFrame([(p, None, *[None] * len(columns), "no such file", None) for p in gone], schema)
    if len(gone) == len(paths):
        return out
    rows = lines(spark, [p for p in paths if p not in gone]).where("line_no > 1 and trim(line) <> ''").withColumn("c", F.split("line", "\t"))
    number = lambda i: F.try_to_number(F.get("c", F.lit(i)), F.lit("999999999")).cast("int")
    given = lambda i: X.blank(F.get("c", F.lit(i))) != ""
    wrong = [F.when(given(i) & number(i).isNull(), F.lit(f"{n} is no number")) for i, n in enumerate(columns) if n in ints]
    error = F.coalesce(F.when(~F.is_valid_utf8("line"), "not UTF-8"), F.when(F.size("c") < least, F.concat(F.lit("only "), F.size("c").cast("string"), F.lit(" columns"))), *wrong, F.lit(None).cast("string"))
    rows = rows.withColumn("error", error)
    cell = lambda i, n: F.coalesce(number(i), F.lit(0)) if n in ints else X.unescape_tsv(F.get("c", F.lit(i)))
    good = F.col("error").isNull()
    read = rows.select("file", "line_no", *[F.when(good, cell(i, n)).alias(n) for i, n in enumerate(columns)], "error", F.when(~good, F.make_valid_utf8("line")).alias("raw"))
    return out.unionByName(read)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    return positional(spark, path, CANDIDATE, CANDIDATE_LEAST, CANDIDATE_INTS)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return positional(spark, path, CORPUS, CORPUS_LEAST)


def optional_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A glossary in corpus form; an absent file is an empty table."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in CORPUS]))
    return corpus(spark, path).select(*CORPUS)


def translations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return positional(spark, path, TRANSLATIONS, TRANSLATIONS_LEAST, ("Index",))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    rows = positional(spark, path, COVERAGE, len(COVERAGE))
    return rows.select(*[F.expr(f"try_cast({c} as double)").alias(c) if c.endswith("Ratio") else F.expr(f"try_cast({c} as bigint)").alias(c) if c not in ("Plugin", "SampleUntranslated") else F.col(c) for c in COVERAGE])


def by_header(spark: SparkSession, path: str | list[str], columns: Sequence[str]) -> DataFrame:
    """A table whose columns are found by name in any order; missing ones are empty."""
    rows = lines(spark, path).withColumn("c", F.split("line", "\t"))
    head = rows.where("line_no = 1").select("file", F.col("c").alias("h"))
    body = rows.where("line_no > 1 and trim(line) <> ''").join(head, "file")
    cell = lambda n: X.unescape_tsv(F.coalesce(F.get("c", (F.array_position("h", n) - 1).cast("int")), F.lit("")))
    return body.select("file", "line_no", *[F.when(F.array_contains("h", n), cell(n)).otherwise("").alias(n) for n in columns])


def find(spark: SparkSession, root: str, name: str = "translations.tsv") -> list[str]:
    """All files of that name below ``root``, sorted; an error if there is none."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path").orderBy("path").collect()
    if not found:
        raise FileNotFoundError(f"no {name} below {root}")
    return [r[0] for r in found]  # file names only


def json_entries(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Entries of JSON array files, and the files that could not be read (set aside, not fatal)."""
    raw = spark.read.schema(DSD_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.col("_metadata.file_path"))
    good = raw.where("_bad is null and form_id is not null or _bad is null and editor_id is not null").drop("_bad")
    w = Window.partitionBy("file").orderBy(F.monotonically_increasing_id())
    return good.withColumn("entry_no", F.row_number().over(w)), raw.where("_bad is not null and form_id is null").select("file").distinct()


def xml_pairs(spark: SparkSession, path: str) -> DataFrame:
    """plugin, type, english, japanese of translation XML; rows with a missing piece are dropped."""
    schema = "Params struct<Addon: string>, Content struct<String: array<struct<REC: string, Source: string, Dest: string>>>"
    raw = spark.read.format("xml").option("rowTag", "SSTXMLRessources").schema(schema).load(path).withColumn("file", F.col("_metadata.file_path"))
    rows = raw.select("file", F.col("Params.Addon").alias("plugin"), F.explode("Content.String").alias("s"))
    out = rows.select("file", "plugin", F.replace("s.REC", F.lit(":"), F.lit(" ")).alias("type"), F.col("s.Source").alias("english"), F.col("s.Dest").alias("japanese"))
    return out.where("plugin is not null and type is not null and english is not null and japanese is not null")


def interface(spark: SparkSession, path: str) -> DataFrame:
    """$key TAB value files: the last value of a key, in the order of first lines. UTF-16 by its byte-order mark, else UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    mark = F.hex(F.substring("content", 1, 2))
    text = F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    rows = raw.select("file", F.posexplode(F.split(F.regexp_replace(text, "^\ufeff", ""), "\r\n|\r|\n")).alias("line_no", "line")).where("startswith(line, '$') and contains(line, '\t')")
    pairs = rows.select("file", (F.col("line_no") + 1).alias("line_no"), F.substring_index("line", "\t", 1).alias("key"), F.regexp_replace("line", "^[^\t]*\t", "").alias("value"))
    return last_wins(pairs)


def ini(spark: SparkSession, path: str) -> DataFrame:
    return sections(lines(spark, path))


def disabled_toggles(settings: DataFrame) -> DataFrame:
    """Keys of section Patcher that are switched off."""
    return settings.where("section = 'Patcher' and try_cast(value as int) = 0").select(F.col("key").alias("toggle"))


def mod_list(spark: SparkSession, path: str, enabled_only: bool = True) -> DataFrame:
    """priority (0 highest), mod, enabled from a +/- list; comments and separators are dropped."""
    rows = lines(spark, path).where(r"line rlike '^[+-]' and not endswith(trim(line), '_separator')")
    df = rows.select("file", "line_no", F.trim(F.expr("substring(line, 2)")).alias("mod"), F.startswith("line", F.lit("+")).alias("enabled"))
    df = df.where("enabled") if enabled_only else df
    return df.withColumn("priority", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).select("file", "priority", "mod", "enabled")


def active_plugins(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).where("startswith(line, '*')")
    return rows.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).alias("pos"), F.trim(F.expr("substring(line, 2)")).alias("plugin"))


def load_order(implicit: DataFrame, forced: DataFrame, active: DataFrame) -> DataFrame:
    """pos, plugin: implicit masters in their order, forced ones by name, then active ones; the first mention counts."""
    part = lambda df, rank, order: df.select(F.lit(rank).alias("r"), order.cast("string").alias("o"), "plugin")
    rows = part(implicit, 0, F.lpad(F.col("pos").cast("string"), 9, "0")).unionByName(part(forced, 1, F.lower("plugin"))).unionByName(part(active, 2, F.lpad(F.col("pos").cast("string"), 9, "0")))
    first = rows.groupBy(F.lower("plugin").alias("k")).agg(F.min(F.struct("r", "o", "plugin")).alias("x"))
    # a load order is a list of files, some hundreds of rows
    return first.select((F.row_number().over(Window.orderBy("x.r", "x.o")) - 1).alias("pos"), "x.plugin")


def plugin_paths(files: DataFrame) -> DataFrame:
    """name, path: the overwrite folder before mods before the game, mods by priority. files: name, path, tier, priority."""
    return files.groupBy(F.lower("name").alias("name")).agg(F.min_by("path", F.struct("tier", "priority")).alias("path"))


def mixed_text(content: Column) -> Column:
    """Bytes as UTF-8 if valid, else as Windows-1252."""
    low = "".join(chr(b) for b in range(0x80, 0xA0))
    western = F.translate(F.decode(content, "ISO-8859-1"), low, CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(western)


def mixed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files, each in its own encoding: CR, LF or CRLF ends, mark at the start skipped.

    The scan keeps a line's bytes as they are, and each line is then decoded for itself.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), mixed_text(F.col("value").cast("binary")).alias("value"))
    return numbered(raw)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(X.trim(F.col("line")).alias("word")).where("word <> '' and not startswith(word, '#')")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """english, japanese of a two-column list; the last row of a key (case ignored) counts."""
    rows = lines(spark, path).where("not startswith(line, '#')").withColumn("c", F.split("line", "\t")).where("size(c) >= 2 and c[0] <> '' and c[1] <> ''")
    return rows.groupBy(F.lower(F.expr("c[0]")).alias("k")).agg(F.max_by(F.struct(F.expr("c[0]").alias("english"), F.expr("c[1]").alias("japanese")), F.struct("file", "line_no")).alias("x")).select("x.*")


def phrase_overrides(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).where("line_no > 1").withColumn("c", F.split("line", "\t"))
    return rows.select(F.trim(F.expr("get(c, 0)")).alias("english"), F.trim(F.expr("get(c, 1)")).alias("japanese")).where("english <> '' and japanese <> ''")
