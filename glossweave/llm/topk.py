"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to many pivots give lower bounds of distances between vectors: |q-c| >= max_p |d(q,p) - d(c,p)|.
With the norms that bounds the inner product from above: q.c = (|q|^2 + |c|^2 - |q-c|^2) / 2. The bound is used three times,
and whatever it cannot rule out is evaluated, so results are exact:

1. vectors are grouped in cells by their nearest pivot, cells lie in blocks of bounded size, and queries in batches. A batch is
   first searched in the blocks of its own cells, which gives every query a score that its k-th best cannot be under;
2. a cell's least and greatest distance to each pivot bound the scores of all its members at once; a batch is sent only to
   blocks where that bound reaches some query's score so far;
3. in a block, cells are taken in the order of their bounds, members by their own bounds pivot by pivot as long as that
   eliminates enough, and the rest in one matrix product, which raises the scores to reach.

A large cell is split by id, so a vector that is repeated very often fills several blocks. Nothing but pivots, a sample of
bounded size and counts of cells comes to the driver.

Defined results: vectors that are null or hold a null or non-finite component take no part, as rows
with a null id; only vectors of one length are compared; candidates with the query's own id
are left out; repeated rows count each as candidates and once as a query; ties go to the smaller id; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, checkpoint, small_batches

#: Rows in a block of candidates and in a batch of queries.
CANDIDATES, QUERIES = 4_096, 1_024
#: Blocks whose summaries are compared with a batch's in one group.
PAGE = 64
#: Pivots, and the bounded sample of vectors they are picked from; neither affects results.
PIVOTS, PIVOT_SAMPLE = 256, 2_048
#: Pivots tried at once, and the share of the candidates left that they must eliminate for more to be tried.
STEP, WORTH = 16, 1 / 8


def pick_pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors, each next one the farthest from those picked, then put in an order in which neighbours are near."""
    if not len(vectors):
        return vectors.reshape(0, vectors.shape[1] if vectors.ndim == 2 else 0)
    picked, far = [0], None
    while len(picked) < min(count, len(vectors)):
        d = np.linalg.norm(vectors - vectors[picked[-1]], axis=1)
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        picked.append(int(far.argmax()))
    rest, path = set(picked[1:]), [picked[0]]
    while rest:
        left = sorted(rest)
        path.append(left[int(np.linalg.norm(vectors[left] - vectors[path[-1]], axis=1).argmin())])
        rest.remove(path[-1])
    return vectors[path]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(sq, 0))


def gaps(low: np.ndarray, high: np.ndarray, q_low: np.ndarray, q_high: np.ndarray) -> np.ndarray:
    """A distance that members of each query cell and each cell (rows: ranges of distances to the pivots) have at least."""
    out = np.zeros((len(q_low), len(low)))
    for k in range(len(low)):
        out[:, k] = np.maximum(low[k] - q_high, q_low - high[k]).max(axis=1, initial=0)
    return out


def slack(*norms: np.ndarray) -> float:
    """More than rounding can lose in a bound."""
    return 1e-6 * (sum(n.max(initial=0) for n in norms) + 1)


def best_of(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries of each row, in order."""
    order = np.lexsort((ids, -scores, row))
    r = row[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[rank < k]


def search_block(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, cells: np.ndarray, pivots: np.ndarray, k: int):
    """(row of q, candidate id, score) of the k best of a block for each query that reach ``least``, and the number of pairs evaluated."""
    top = max(1, int(np.abs(c).max(initial=0)), int(np.abs(q).max(initial=0)))
    kind = np.float64 if c.shape[1] * top * top < 1 << 53 else np.int64  # exact either way
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    cn, qn = (cf**2).sum(1), (qf**2).sum(1)
    c_far, q_far, extra = distances(cf, pivots), distances(qf, pivots), slack(cn, qn)
    c, q, least = c.astype(kind), q.astype(kind), least.astype(np.float64)
    names, inverse = np.unique(cells, return_inverse=True)
    members = [np.flatnonzero(inverse == j) for j in range(len(names))]
    low, high = np.stack([c_far[m].min(0) for m in members]), np.stack([c_far[m].max(0) for m in members])
    most = np.array([cn[m].max() for m in members])
    roof = (most + qn[:, None] - gaps(low, high, q_far, q_far) ** 2) / 2 + extra
    between = distances(pivots, pivots)
    row, ids, scores, evaluated = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for j in np.argsort(-roof.max(axis=0), kind="stable").tolist():
        at = np.flatnonzero(roof[:, j] >= least)
        if not len(at):
            continue
        m = members[j]
        need = np.maximum(qn[at][:, None] + cn[m] + 2 * extra - 2 * least[at][:, None], 0)  # a squared distance over this one is too far
        alive = q_ids[at][:, None] != c_ids[m]
        near = np.argsort(between[names[j]], kind="stable") if len(pivots) else np.zeros(0, np.int64)
        for s in range(0, len(near), STEP):
            before = np.count_nonzero(alive)
            for p in near[s : s + STEP].tolist():
                alive &= (q_far[at, p][:, None] - c_far[m, p]) ** 2 <= need
            if np.count_nonzero(alive) > (1 - WORTH) * before:
                break
        rows, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            continue
        alive = alive[np.ix_(rows, columns)]
        evaluated += int(np.count_nonzero(alive))
        s = q[at[rows]] @ c[m[columns]].T
        r, x = np.nonzero(alive & (s >= least[at[rows]][:, None]))
        row, ids, scores = np.append(row, at[rows[r]]), np.append(ids, c_ids[m[columns[x]]]), np.append(scores, s[r, x].astype(np.int64))
        keep = best_of(row, ids, scores, k)
        row, ids, scores = row[keep], ids[keep], scores[keep]
        full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
        last = np.searchsorted(row, full, side="right") - 1
        least[full] = np.maximum(least[full], scores[last])
    return row, ids, scores, evaluated


def quantised(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).where(ok).select(F.col(id).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"), F.size(vector).alias("dim"))


def matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, dim)


def packed(rows: DataFrame, size: int, tie: Column) -> DataFrame:
    """Rows (id, v, dim, cell) as one row (dim, block, n, ids, vs, cells) for each run of about ``size`` rows along the order of cells.

    Rows of a large cell are dealt by a hash of their id and ``tie``, which must be the same whenever a task runs again."""
    spark = rows.sparkSession
    counts = sorted((r["dim"], r["cell"], r["count"]) for r in rows.groupBy("dim", "cell").count().collect())  # at most PIVOTS a length
    places, block, filled, was = [], -1, 0, None
    for dim, cell, n in counts:
        if was != dim or filled + n > size:
            block, filled, was = block + 1, 0, dim
        parts = -(-n // size)
        places.append((dim, cell, block, parts))
        block, filled = block + parts - 1, filled + n if parts == 1 else size
    where = F.broadcast(spark.createDataFrame(places, "dim int, cell int, first long, parts long"))  # one row a cell
    dealt = rows.join(where, ["dim", "cell"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", tie), F.col("parts")))

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id", kind="stable")
        ids, vs, cells = p["id"].to_numpy("<i8"), np.array(p["v"].tolist(), "<i8"), p["cell"].to_numpy("<i8")
        return pd.DataFrame({"dim": p["dim"].iloc[:1], "block": p["block"].iloc[:1], "n": len(p), "ids": [ids.tobytes()], "vs": [vs.tobytes()], "cells": [cells.tobytes()]})

    return checkpoint(dealt.select("id", "v", "dim", "cell", "block").groupBy("dim", "block").applyInPandas(pack, "dim int, block long, n long, ids binary, vs binary, cells binary"))


def top_k(df: DataFrame, k: int = 5, every: int = 50, id: str = "vec_id", vector: str = "embedding", scale: int = 256, pivots: int = PIVOTS, evaluated: Accumulator | None = None) -> DataFrame:
    """The ``k`` best of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    ``evaluated`` counts the pairs whose score was computed.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = quantised(df, id, vector, scale)
    by_dim: dict[int, list] = {}
    for r in rows.select("dim", "v").orderBy(F.xxhash64("id"), "id", "v").limit(PIVOT_SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(r["v"])
    chosen = {d: pick_pivots(np.array(v, np.float64), pivots) for d, v in by_dim.items()}
    of = lambda d: chosen[d] if d in chosen else np.zeros((0, d))

    def locate(batches):
        for p in batches:
            cell = np.zeros(len(p), np.int64)
            for d, at in p.groupby("dim").indices.items():
                if len(of(d)):
                    cell[at] = distances(np.array(p["v"].iloc[at].tolist(), np.float64).reshape(len(at), d), of(d)).argmin(1)
            p["cell"] = cell
            yield p

    rows = checkpoint(rows.mapInPandas(locate, "id long, v array<long>, dim int, cell int"))
    blocks = packed(rows, CANDIDATES, F.monotonically_increasing_id())  # rows of a scan keep their places
    batches = packed(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]), QUERIES, F.col("v")).withColumnRenamed("block", "batch")
    batches = batches.select("dim", "batch", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vs").alias("qs"), F.col("cells").alias("qcells"))

    def summarise(found):
        for b in found:
            for r in b.to_pylist():
                v, cells, least = matrix(r["vs"], r["n"], r["dim"]).astype(np.float64), np.frombuffer(r["cells"], "<i8"), np.full(r["n"], -np.inf)
                for x in r["reached"] or []:
                    least[x["row"]] = x["score"]
                far, norm = distances(v, of(r["dim"])), (v**2).sum(1)
                members = [cells == c for c in np.unique(cells)]
                parts = [np.stack([far[m].min(0) for m in members]), np.stack([far[m].max(0) for m in members]), np.array([norm[m].max() for m in members]), np.array([least[m].min() for m in members])]
                made = {name: pa.array([x.tobytes()]) for name, x in zip(("low", "high", "most", "floor"), parts)}
                yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "block": [r["block"]], **made, "least": [least.astype("<f8").tobytes()]})

    def search(found):
        for b in found:
            for r in b.to_pylist():
                q, c = matrix(r["qs"], r["qn"], r["dim"]), matrix(r["vs"], r["n"], r["dim"])
                q_ids, least = np.frombuffer(r["qids"], "<i8"), np.frombuffer(r["least"], "<f8") if r.get("least") else np.full(r["qn"], -np.inf)
                row, ids, scores, count = search_block(q, q_ids, least, c, np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["cells"], "<i8"), of(r["dim"]), k)
                if evaluated is not None:
                    evaluated.add(count)
                yield pa.RecordBatch.from_pydict({"batch": pa.array([r["batch"]] * len(row), pa.int64()), "row": pa.array(row, pa.int64()), "query_id": pa.array(q_ids[row], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    found = "batch long, row long, query_id long, vec_id long, score long"
    cell_list = lambda c: F.expr(f"transform(sequence(0, length({c}) div 8 - 1), i -> substring({c}, cast(i * 8 + 1 as int), 8))")
    homes = blocks.select("dim", "block", F.explode(F.array_distinct(cell_list("cells"))).alias("cell"))
    wanted = batches.select("dim", "batch", F.explode(F.array_distinct(cell_list("qcells"))).alias("cell"))
    own = wanted.join(homes, ["dim", "cell"]).groupBy("dim", "batch").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    own = own.select("dim", "batch", F.explode(F.array_distinct(F.array("first", "last"))).alias("block"))  # any block will do; near ones do best
    first = checkpoint(own.join(blocks, ["dim", "block"]).join(batches, ["dim", "batch"]).mapInArrow(search, found))
    place = Window.partitionBy("batch", "row").orderBy(F.desc("score"))
    reached = first.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).groupBy("batch").agg(F.collect_list(F.struct("row", "score")).alias("reached"))
    summary = "dim int, block long, low binary, high binary, most binary, floor binary, least binary"
    cells = checkpoint(blocks.withColumn("reached", F.lit(None).cast("array<struct<row:long,score:long>>")).mapInArrow(summarise, summary))
    asked = batches.join(reached, "batch", "left").select("dim", F.col("batch").alias("block"), F.col("qn").alias("n"), F.col("qids").alias("ids"), F.col("qs").alias("vs"), F.col("qcells").alias("cells"), "reached")
    asked = checkpoint(asked.mapInArrow(summarise, summary))

    def route(found):
        for b in found:
            for r in b.to_pylist():
                most, q_most, floor = np.frombuffer(r["most"]), np.frombuffer(r["qmost"]), np.frombuffer(r["floor"])
                low, high, q_low, q_high = (np.frombuffer(r[c]).reshape(len(n), -1) for c, n in (("low", most), ("high", most), ("qlow", q_most), ("qhigh", q_most)))
                roof = (most + q_most[:, None] - gaps(low, high, q_low, q_high) ** 2) / 2 + slack(most, q_most)
                if (roof >= floor[:, None]).any():
                    yield pa.RecordBatch.from_pydict({"dim": pa.array([r["dim"]], pa.int32()), "batch": [r["batch"]], "block": [r["block"]]})

    # a stated query set against all rows, in blocks: pages of summaries, a few KB a cell, meet each batch's summary
    pages = max(1, -(-cells.count() // PAGE))
    paged = cells.select("dim", "block", "low", "high", "most", F.pmod("block", F.lit(pages)).alias("page"))
    asking = asked.select("dim", F.col("block").alias("batch"), F.col("low").alias("qlow"), F.col("high").alias("qhigh"), F.col("most").alias("qmost"), "floor", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))).alias("page"))
    pairs = asking.join(paged, ["dim", "page"]).mapInArrow(route, "dim int, batch long, block long").join(own, ["dim", "batch", "block"], "left_anti")
    best = pairs.join(bounded(blocks, "vs"), ["dim", "block"]).join(batches.join(asked.select(F.col("block").alias("batch"), "least"), "batch"), ["dim", "batch"]).mapInArrow(search, found)
    best = best.unionByName(first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
