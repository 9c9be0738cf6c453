"""Writers of the file formats. Text tables are rendered by expressions and written by tasks; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.iface import output_text


def tsv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws("\t", *[X.escape_tsv(F.col(c).cast("string")) for c in columns])


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], partition: str | None = None) -> None:
    """Escaped tab-separated files with a header in each, one folder a value of ``partition`` if given.

    The header is the CSV writer's; cells are escaped, so no quoting is needed.
    """
    cells = df.select(*([F.col(partition).alias("_folder")] if partition else []), *[X.escape_tsv(F.col(c).cast("string")).alias(c) for c in columns])
    w = cells.write.mode("overwrite").option("sep", "\t").option("header", "true").option("quote", "").option("escape", "\u0000").option("emptyValue", "").option("nullValue", "")
    (w.partitionBy("_folder") if partition else w).csv(path)


def write_corpus(df: DataFrame, path: str, columns: Sequence[str]) -> int:
    """Write distinct rows; returns how many repeats were left out."""
    once = df.select(*columns).dropDuplicates()
    write_tsv(once, path, columns)
    return df.count() - once.count()


def candidate_list(df: DataFrame) -> DataFrame:
    """plugin, n, rank_key and text of the human-readable list: plugins by count, rows by form id."""
    per = df.groupBy("plugin").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("form_id", "text"))), lambda x: F.concat_ws("\t", x["form_id"], X.preview(x["text"]))), "\n").alias("text"))
    return per.orderBy(F.desc("n"), "plugin")


def json_files(df: DataFrame) -> DataFrame:
    """plugin, json: one array a plugin, entries in row order; empty plugins give no row."""
    fields = ["editor_id", "form_id", "index", "type", "original", "string", "status"]
    per = df.groupBy("plugin").agg(F.array_sort(F.collect_list(F.struct("row_id", *fields))).alias("e"))
    return per.select("plugin", F.to_json(F.transform("e", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("json"))


def write_json(df: DataFrame, root: str) -> None:
    """One folder a plugin below ``root``, which is replaced."""
    json_files(df).write.mode("overwrite").partitionBy("plugin").text(root)


def write_texts(df: DataFrame, root: str, path: str = "path") -> None:
    """One file's text a row, in a folder named by its path."""
    df.select(F.col(path), F.col("text").alias("value")).write.mode("overwrite").partitionBy(path).text(root)


def interface_lines(df: DataFrame) -> DataFrame:
    return df.select("line_no", F.concat_ws("\t", "key", output_text(F.col("japanese"), F.col("english"))).alias("line"))


def write_interface(df: DataFrame, path: str) -> None:
    """One UTF-16 little-endian file with a mark and CRLF ends. Spark's text writer knows UTF-8 only, and such a file is one
    mod's strings, so the driver streams its lines to the file system of ``path``."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(b"\xff\xfe"))
        for r in interface_lines(df).orderBy("line_no").toLocalIterator():
            out.write(bytearray((r["line"] + "\r\n").encode("utf-16-le")))
    finally:
        out.close()


def prompt_package(df: DataFrame) -> DataFrame:
    """text, n, ids, hints: identical texts once, hints joined in order."""
    return df.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("hint")), "; ").alias("hints"))


def grouped_list(df: DataFrame, category: str, item: str) -> DataFrame:
    """category, item, n with the category's distinct items: counts first, then items."""
    per = df.groupBy(category, item).agg(F.count(F.lit(1)).alias("n"))
    kinds = per.groupBy(category).agg(F.count(F.lit(1)).alias("kinds"))
    return per.join(kinds, category).orderBy(category, F.desc("n"), item)
