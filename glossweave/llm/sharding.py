"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a small grid, rows are put in the order of the
grid cell's Hilbert index and the order is cut into runs of equal count. Neighbouring cells
share runs, so a shard's minimum and maximum of every dimension prune well.

Defined results: a null text counts as empty (size is the row overhead alone); null metadata
sorts last as a value of its own; equal rows keep separate slots; fewer rows than shards leave
shards empty; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, ordered

ROW_BYTES = 16  # fixed by the contract
#: The grid's curve indices are one broadcast table of at most 2^MAX_GRID_BITS rows.
MAX_GRID_BITS = 18


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve indices of integer points, one row each, with ``bits`` bits a dimension.

    Follows Skilling, "Programming the Hilbert curve" (2004): undo excess work from the top
    bit down, Gray-encode, and interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip ^= np.where(x[dims - 1] & q, q - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for k in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> k) & 1)
    return out


def with_rank_cell(df: DataFrame, column: str, cells: int, name: str) -> DataFrame:
    """Add the cell of ``column``: the rank of its value among the distinct values, scaled to ``cells``."""
    values, n, _ = ordered(df.select(column).distinct(), [F.asc_nulls_last(column)])
    dim = values.select(F.col(column).alias("_value"), F.floor(F.col("_pos") * cells / F.lit(max(n, 1))).cast("int").alias(name))
    return df.join(bounded(dim, "_value"), F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def shard(docs: DataFrame, shards: int = 40, id: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), bits: int = 5) -> DataFrame:
    """One row per document: ``id``, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Dimensions are the ranks of ``dimensions`` and the size's place on a logarithmic scale.
    Shard counts are at most one apart; slots are gapless from 0 in curve order.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(id).alias("id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *[F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)])
    for i in range(len(dimensions)):
        df = with_rank_cell(df, f"d{i}", 1 << bits, f"c{i}")
    top = (1 << bits) - 1
    df = df.withColumn("cs", F.least(F.floor(F.log2(F.col("size").cast("double")) * top / F.lit(31.0)), F.lit(top)).cast("int"))
    width = len(dimensions) + 1
    if bits * width > MAX_GRID_BITS:
        raise ValueError(f"the grid has more than 2^{MAX_GRID_BITS} cells")
    cells = np.arange(1 << bits * width)
    points = np.stack([(cells >> bits * (width - 1 - i)) & top for i in range(width)], axis=1)
    grid = docs.sparkSession.createDataFrame(list(zip(cells.tolist(), hilbert_index(points, bits).tolist())), "cell long, curve long")
    cell = F.lit(0).cast("long")
    for c in [*(f"c{i}" for i in range(len(dimensions))), "cs"]:
        cell = cell * (1 << bits) + F.col(c)
    df = df.withColumn("cell", cell).join(F.broadcast(grid), "cell")  # at most 2^MAX_GRID_BITS rows of 16 bytes
    df = df.select("id", "size", "text_crc32", "curve")
    df, n, _ = ordered(df, [F.col("curve"), F.col("text_crc32"), F.col("id"), F.col("size")])
    df = df.withColumn("shard", F.expr(f"int((_pos * {shards}L) div {max(n, 1)}L)"))
    first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return df.select(F.col("id").alias(id), "size", "text_crc32", "curve", "shard", (F.col("_pos") - first).alias("slot"))


def write(docs: DataFrame, assigned: DataFrame, path: str, id: str = "doc_id", files: int = 1) -> None:
    """Write the documents under one folder per shard, in slot order, ``files`` files a shard."""
    placed = docs.join(assigned.select(id, "shard", "slot"), id)
    (placed.withColumn("_file", F.pmod("slot", F.lit(files))).repartition("shard", "_file").sortWithinPartitions("shard", "_file", "slot").drop("_file").write.partitionBy("shard").mode("overwrite").parquet(path))
