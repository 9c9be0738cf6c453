"""Shared pieces of the training-data operators: durable cuts, global order, components."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Upper-case ASCII, the only letters that the fingerprint contract folds.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only when it has been counted and is at most this large.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for durable cuts: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; a cluster without is refused.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="glossweave-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Give back what finished driver-side work holds: samples in Python, results and plans in the JVM."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bounded(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` with a broadcast hint if, counted, it is under the broadcast bound; else as it is."""
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16) if text else F.lit(0)
    n, b = df.agg(F.count(F.lit(1)), size).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (b or 0) <= BROADCAST_BYTES else df


def ordered(df: DataFrame, keys: list[Column], weight: str | None = None) -> tuple[DataFrame, int, int]:
    """Number the rows of ``df`` by ``keys`` without one task ever holding them all.

    Range partitioning, a local sort and a checkpoint fix the order; one small row per
    partition gives every partition its offset. Adds ``_pos`` (from 0) and ``_start`` (the
    sum of ``weight`` before the row). Returns the rows, their count and the whole weight.
    Keys must tell apart rows of a hot key, so that they spread over partitions.
    """
    spark = df.sparkSession
    cut = checkpoint(df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys))
    w = F.col(weight) if weight else F.lit(0)
    per = cut.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))
    base, n, total = {}, 0, 0
    for r in sorted(per.collect()):  # one row per partition
        base[r["pid"]] = (n, total)
        n, total = n + r["n"], total + int(r["w"] or 0)
    if not weight:
        offsets = [base.get(i, (0, 0))[0] for i in range(max(base, default=0) + 1)]
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        place = F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.spark_partition_id()) + within
        return cut.withColumn("_pos", place).withColumn("_start", F.lit(0).cast("long")), n, total
    schema = T.StructType([*cut.schema.fields, T.StructField("_pos", T.LongType()), T.StructField("_start", T.LongType())])

    def run(batches):
        pos, start = base.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            size = b.column(weight).to_numpy(zero_copy_only=False) if weight else np.zeros(b.num_rows, np.int64)
            sums = np.cumsum(size, dtype=np.int64)
            at = np.arange(pos, pos + b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(start + sums - size, pa.int64())], names=schema.names)
            pos, start = pos + b.num_rows, start + int(sums[-1] if len(sums) else 0)

    return cut.mapInArrow(run, schema), n, total


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: rows (node, root), root the least node.

    Alternates large-star and small-star steps, each a grouped minimum and a join on the node,
    with a checkpoint a round, until the edge set repeats. A hub's rows are joined with its
    one minimum, so a skewed join splits them; nothing is collected.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = checkpoint(e), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            release(e.sparkSession)
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        near = step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(near.unionByName(step.select("u", F.col("m").alias("v"))).distinct())


def grouped(values: list, limit: int = 1 << 17):
    """Index ranges of a list of strings or bytes, of about ``limit`` units each."""
    at, size = 0, 0
    for i, x in enumerate(values):
        size += len(x or "")
        if size >= limit:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(values):
        yield at, len(values)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so (case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Arrow batches that go to Python are held under this size, so that a worker's memory does not depend on the lengths of texts.
BATCH_BYTES = 4 << 20
_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.ArrayType: pa.list_(pa.int64())}


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches under ``BATCH_BYTES``, unless it asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def map_texts(docs: DataFrame, text: str, keep: tuple[str, ...], fields: list[T.StructField], fn) -> DataFrame:
    """Columns ``keep`` and new ``fields``, made from column ``text`` by ``fn(texts)``.

    ``fn`` gets a list of texts of bounded total size and returns one list of values a field. Only the text goes to
    Python and only the new values come back; kept columns stay in the JVM.
    """
    small_batches(docs.sparkSession)
    names, types = [f.name for f in fields], [_ARROW[type(f.dataType)] for f in fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = b.to_pylist()
            parts = [fn(texts[lo:hi]) for lo, hi in grouped(texts)] or [[[] for _ in fields]]
            yield pa.StructArray.from_arrays([pa.concat_arrays([pa.array(p[k], t) for p in parts]) for k, t in enumerate(types)], names=names)

    made = unused(docs.columns, "_made")
    out = docs.withColumn(made, F.arrow_udf(run, T.StructType(fields))(F.col(text).cast("string")))
    return out.select(*keep, *[F.col(made)[n].alias(n) for n in names])
