"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Vectors are dealt into blocks.  A block's index has, for every dimension, the
vectors posted by quantised impact (the component's size in steps).  For a
block of queries the posting segments are processed by falling impact, adding
to the accumulators; from what is still unprocessed follows a bound on every
score's error.  Processing stops only when that bound proves that few vectors
can be among the k best; those are rescored on their exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries in a block; quantisation step as a power of two.
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024
STEP_BITS = 2


class ImpactIndex:
    """Posting segments of one block, by falling impact, with error bounds."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        size = np.abs(vectors)
        level = (size >> STEP_BITS).T  # dimension x vector
        half = ((1 << STEP_BITS) - 1) / 2
        self.segments = []  # (impact, [(dimension, vectors, signed contribution)])
        by_level: dict[int, list] = {}
        for d in range(level.shape[0]):
            order = np.argsort(-level[d], kind="stable")
            values, start = np.unique(-level[d][order], return_index=True)
            for v, ids in zip((-values).tolist(), np.split(order, start[1:]), strict=True):
                by_level.setdefault(v, []).append((d, ids, np.sign(vectors[ids, d]) * ((v << STEP_BITS) + half)))
        top = level.max(axis=1, initial=0)
        for v in sorted(by_level, reverse=True):
            # what may be missing after this segment: half a step where a component is in, a step's end below it where not
            bound = np.where(top >= v, np.maximum(half, (v << STEP_BITS) - 1), ((top + 1) << STEP_BITS) - 1)
            self.segments.append((v, by_level[v], bound if v else np.full(len(top), half)))

    def search(self, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query row, vector row, score): the k best of each query, by score and then id."""
        acc = np.zeros((len(ids), len(queries)))
        size = np.abs(queries).astype(float)
        own = ids[:, None] == query_ids[None, :]
        checks = {s[0] for s in self.segments if s[0] and s[0] & (s[0] - 1) == 0}

        def least(error):
            """Lower bound on each query's k-th best among the other ids; none where they are fewer."""
            want = min(k, len(ids))
            return np.partition(np.where(own, -np.inf, acc), len(ids) - want, axis=0)[len(ids) - want] - error

        for v, postings, bound in self.segments:
            for d, rows, part in postings:
                acc[rows] += part[:, None] * queries[None, :, d]
            if v in checks:
                error = size @ bound
                if (((acc + error >= least(error)) & ~own).sum(0) <= 4 * k).all():
                    break
        error = size @ bound + 1e-6
        member = (acc + error >= least(error)) & ~own
        out = []
        for j in range(len(queries)):
            rows = np.flatnonzero(member[:, j])
            score = self.vectors[rows] @ queries[j]
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), j), rows[best], score[best]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def exact_topk(vectors: DataFrame, query_every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(scale * x).

    Queries are the rows whose id is divisible by ``query_every``; candidates
    are all rows with another id.  Equal scores go to the smaller id.  Rows
    with a null id, a null vector or any null or non-finite component take no
    part; missing trailing components count as 0.  Repeated rows are candidates
    each.  No rows, or no queries, give no rows.  Components so large that a score
    might not fit in 64 bits raise an error.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))
    is_query = F.col("id") % query_every == 0
    size = F.aggregate("v", F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v.cast("double"))))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(size).alias("top"), F.max(F.size("v")).alias("width")).first()
    if (totals.width or 0) * (totals.top or 0.0) ** 2 >= 2.0**62:
        raise ValueError("components too large for exact scores in 64 bits")
    blocks, query_blocks = max(1, -(-totals.n // VECTOR_BLOCK)), max(1, -(-(totals.q or 0) // QUERY_BLOCK))

    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", deal(blocks).alias("block"), each(query_blocks).alias("qblock"))
    right = rows.where(is_query).distinct().select("id", "v", each(blocks).alias("block"), deal(query_blocks).alias("qblock"))

    def matrix(t: pa.Table, width: int) -> np.ndarray:
        lists = t.column("v").combine_chunks()
        n = lists.value_lengths().to_numpy(zero_copy_only=False)
        out = np.zeros((t.num_rows, width), np.int64)
        out[np.arange(width) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            q, r, s = (np.zeros(0, np.int64),) * 3
            ids = qids = q
        else:
            width = max(1, *(int(np.max(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))) for t in (a, b)))
            ids, qids = a.column("id").to_numpy(), b.column("id").to_numpy()
            q, r, s = ImpactIndex(matrix(a, width)).search(ids, qids, matrix(b, width), k)
        return pa.table({"query_id": pa.array(qids[q], pa.int64()), "vec_id": pa.array(ids[r], pa.int64()), "score": pa.array(s, pa.int64())})

    found = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
