"""Exact top-k inner products by distributed histogram selection.

The queries go out in blocks of bounded size.  For each block every vector is
scored three times over at most: a task scores its vectors against the block
as one matrix product and reports, per query, a histogram of the scores at or
above its own k-th best (no lower score can be among the k best of all).  The
summed histograms give for each query the bin that holds its k-th score; the
next round divides that bin, until it is one score wide.  Then all scores
above, and those equal to the k-th, are filtered and ties are broken by id.

Scores are integers; products run in double precision while every partial sum
is below 2**53 (checked on the data), where they are exact, else on Python
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

BLOCK_VALUES = 1 << 20  # components of the queries in one block
BINS = 256
EXACT = float(1 << 53)
SCALE = 256


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, top)``: components floor(256 x) as doubles, and the largest absolute one; without unusable vectors."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(id_col).isNotNull() & v.isNotNull()).where(~bad)
    q = F.transform(v, lambda x: F.floor(x * SCALE).cast("double"))
    out = good.select(F.col(id_col).cast("long").alias("id"), q.alias("v"))
    return out.withColumn("top", F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def scores(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (v @ q.T).astype(np.int64)
    return np.array(v.astype(np.int64).astype(object) @ q.T.astype(np.int64).astype(object), dtype=object).astype(np.int64)


def scored(b: pa.RecordBatch, dim: int, ids: np.ndarray, q: np.ndarray, exact: bool, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scores (vectors by queries) of a batch, a query's own row at the lowest value."""
    own = b.column(0).to_numpy(zero_copy_only=False)
    v = matrix(b.column(1), dim)
    step = max(1, min(step, (1 << 22) // max(1, len(ids))))
    at = {int(i): n for n, i in enumerate(ids)}
    for lo in range(0, len(own), step):
        s = scores(q, v[lo : lo + step], exact)
        for n in np.flatnonzero(np.isin(own[lo : lo + step], ids)):
            s[n, at[int(own[lo + n])]] = np.iinfo(np.int64).min
        yield own[lo : lo + step], s


def block_top(candidates: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, exact: bool) -> DataFrame:
    """``(query_id, vec_id, score)``: for each query of the block the scores not below its k-th."""
    spark = candidates.sparkSession
    n, dim = q.shape
    sent = spark.sparkContext.broadcast((ids, q))
    lowest = np.iinfo(np.int64).min

    def histogram(lo: np.ndarray, width: np.ndarray):
        """Counts by bin for each query; bin -1: below ``lo``, BINS: above the last."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = np.full((0, n), lowest, dtype=np.int64)
            total = np.zeros((n, BINS + 2), dtype=np.int64)
            for b in batches:
                for _, s in scored(b, dim, ids, q, exact):
                    best = np.concatenate([best, s])
                    if len(best) > k:
                        best = np.partition(best, len(best) - k, axis=0)[-k:]
                    bins = np.clip((s - lo) // width, -1, BINS) + 1
                    bins[s == lowest] = 0
                    flat = np.bincount((bins + np.arange(n) * (BINS + 2)).ravel(), minlength=n * (BINS + 2))
                    total += flat.reshape(n, -1)
            # bins below the task's own k-th best cannot matter
            floor = best.min(axis=0) if len(best) == k else np.full(n, lowest)
            first = np.where(floor == lowest, 0, np.clip((np.maximum(floor, lo - 1) - lo) // width, -1, BINS) + 1)
            total[np.arange(BINS + 2) < first[:, None]] = 0
            i, j = np.nonzero(total)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["q", "bin", "n"])

        got = candidates.mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros((n, BINS + 2), dtype=np.int64)
        out[got["q"].to_numpy(), got["bin"].to_numpy()] = got["n"].to_numpy()
        return out

    # every score lies within +- this bound of its query
    top = candidates.agg(F.max("top")).first()[0] or 0.0
    bound = np.array([int(x) for x in np.abs(q).sum(axis=1) * top], dtype=np.int64) + 1
    lo, width = -bound, np.maximum(1, -(-(2 * bound + 1) // BINS))
    need = np.full(n, k)
    whole = np.zeros(n, dtype=bool)  # fewer than k candidates: take them all
    while True:
        h = histogram(lo, width)
        above = np.cumsum(h[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or a higher one
        reach = above >= need[:, None]
        bin_ = np.where(reach.any(axis=1), BINS + 1 - np.argmax(reach[:, ::-1], axis=1), 0)
        whole |= ~reach.any(axis=1) | (bin_ == 0)
        done = whole | (width == 1)
        kth = np.where(whole, lowest + 1, lo + (bin_ - 1) * width)
        if done.all():
            break
        # one finer round: the bin of the k-th score; what lies above it is counted as before
        lo = np.where(done, lo, lo + (bin_ - 1) * width)
        width = np.where(done, width, -(-width // BINS))
    limit = spark.sparkContext.broadcast(kth)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores from the k-th on; of many equal to it, the k with the smallest ids are all a task can add."""
        ids, q = sent.value
        least = limit.value
        have = [np.zeros(0, np.int64)] * 3  # query, score, id
        for b in batches:
            for own, s in scored(b, dim, ids, q, exact):
                i, j = np.nonzero(s >= least)
                have = [np.concatenate(x) for x in zip(have, (j, s[i, j], own[i]), strict=True)]
                order = np.lexsort((have[2], -have[1], have[0]))
                have = [x[order] for x in have]
                rank = np.arange(len(order)) - np.searchsorted(have[0], have[0])
                have = [x[rank < k] for x in have]
        yield pa.record_batch([pa.array(ids[have[0]]), pa.array(have[2]), pa.array(have[1])], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(keep, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best candidates of every row whose id is divisible by ``every``.

    All rows but those of the query's own id are candidates; repeated rows are
    candidates each, and one query.  Null ids and vectors that are null or hold
    null or non-finite components take no part; vectors of different lengths
    are never scored against each other.  Of queries that share an id the
    vector that sorts first counts.  Fewer than ``k`` candidates: all."""
    spark = rows.sparkSession
    good = quantised(rows, id_col, vector_col)
    good = stored(good.withColumn("dim", F.size("v")), "vectors")
    parts = []
    for shape in good.where(F.pmod("id", F.lit(every)) == 0).groupBy("dim").agg(F.count("*").alias("n"), F.max("top").alias("top")).collect():
        same = good.where(F.col("dim") == shape.dim)
        most = same.agg(F.max("top")).first()[0]
        exact = most * most * max(1, shape.dim) < EXACT
        asked = same.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")).orderBy("id")
        size = max(1, BLOCK_VALUES // max(1, shape.dim))
        after = None
        while True:  # blocks of queries, by id
            block = (asked if after is None else asked.where(F.col("id") > after)).limit(size).toArrow()
            if not len(block):
                break
            ids = block["id"].to_numpy()
            q = matrix(block["v"].combine_chunks(), shape.dim) if shape.dim else np.zeros((len(ids), 0))
            parts.append(stored(block_top(same.select("id", "v", "top"), ids, q, k, exact), "block"))
            after = int(ids[-1])
            if len(ids) < size:
                break
    empty = spark.createDataFrame([], "query_id long, vec_id long, score long")
    found = empty
    for p in parts:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
