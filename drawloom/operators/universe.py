"""The whole outcome universe of a game, numbered, in blocks.

Outcome i of C(n, k) is the i-th combination in the combinatorial number system:
its sorted numbers c1 < c2 < ... (from 0) give i = C(c1, 1) + C(c2, 2) + ....
Numbers and outcomes are turned into each other by formula, so nothing is joined
to enumerate, and what tickets reach is a bitmap over the numbers: blocks of
Spark's bitmap size, made in the tasks and merged by ``bitmap_or_agg``.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Positions of one bitmap of Spark's bitmap aggregates, and outcomes made at once.
BITS = 32_768


def binomials(n: int, k: int) -> np.ndarray:
    """C(a, b) for a up to n and b up to k."""
    return np.array([[comb(a, b) for b in range(k + 1)] for a in range(n + 1)], np.int64)


def unrank(index: np.ndarray, n: int, k: int) -> np.ndarray:
    """The combinations with these numbers, one row of k numbers from 1 to n each."""
    table = binomials(n, k)
    left, out = np.array(index, np.int64), np.empty((len(index), k), np.int64)
    for b in range(k, 0, -1):
        out[:, b - 1] = np.searchsorted(table[:, b], left, side="right") - 1
        left = left - table[out[:, b - 1], b]
    return out + 1


def rank(numbers: np.ndarray, n: int) -> np.ndarray:
    """The numbers of combinations given as rows in rising order."""
    k = numbers.shape[1]
    return binomials(n, k)[numbers - 1, np.arange(1, k + 1)].sum(1)


def rank_column(numbers: Column, n: int, k: int) -> Column:
    """``rank`` of a sorted array of k numbers as a column."""
    table = F.array(*(F.array(*(F.lit(comb(a, b)).cast("bigint") for a in range(n))) for b in range(1, k + 1)))
    terms = F.transform(numbers, lambda x, i: F.element_at(F.element_at(table, i + 1), x.cast("int")))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda acc, t: acc + t)


def outcomes(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(outcome, numbers): every combination, unranked block by block."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                index = np.arange(block * BITS, min((block + 1) * BITS, comb(n, k)))
                flat = pa.array(unrank(index, n, k).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1, dtype=np.int32) * k), flat)], ["outcome", "numbers"])

    blocks = -(-comb(n, k) // BITS)
    return spark.range(0, blocks, 1, blocks).mapInArrow(run, "outcome bigint, numbers array<bigint>")


def shapes(numbers: np.ndarray) -> np.ndarray:
    """Sum, span, odd numbers, consecutive pairs, low half, longest run, share up to 12, share up to 31, arithmetic complexity of combinations of 33."""
    k = numbers.shape[1]
    gap = np.diff(numbers, axis=1)
    run, best = np.ones(len(numbers), np.int64), np.ones(len(numbers), np.int64)
    for i in range(k - 1):
        run = np.where(gap[:, i] == 1, run + 1, 1)
        best = np.maximum(best, run)
    apart = np.zeros(len(numbers), np.int64)  # the differences that occur, as bits
    for i, j in combinations(range(k), 2):
        apart |= np.int64(1) << (numbers[:, j] - numbers[:, i])
    share = lambda top: np.round((numbers <= top).sum(1) / k, 6)
    return np.stack(
        [numbers.sum(1), numbers[:, -1] - numbers[:, 0], (numbers % 2).sum(1), (gap == 1).sum(1), (numbers <= 16).sum(1), best, share(12), share(31), np.bitwise_count(apart).astype(np.int64) - (k - 1)], 1
    ).astype(np.float64)


#: The columns of ``shapes``.
SHAPES = ("total", "span", "odd", "pairs", "low", "longest_run", "share12", "share31", "complexity")


def shape_counts(spark: SparkSession, n: int, k: int, features: Callable[[np.ndarray], np.ndarray] = shapes) -> DataFrame:
    """(features, c): how many outcomes have each vector of features, counted in each block before they are shuffled."""

    def run(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                x, c = np.unique(features(unrank(np.arange(block * BITS, min((block + 1) * BITS, comb(n, k))), n, k)), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())), pa.array(c)], ["features", "c"])

    blocks = -(-comb(n, k) // BITS)
    return spark.range(0, blocks, 1, blocks).mapInArrow(run, "features array<double>, c bigint").groupBy("features").agg(F.sum("c").alias("c"))


def reached(tickets: DataFrame, n: int, k: int, least: int) -> DataFrame:
    """(block, reached): bitmaps of the outcomes in which some ticket has ``least`` hits or more.

    ``tickets`` has ``main``, sorted arrays of k numbers.  A task sets the bits
    of all its tickets in bitmaps of the whole universe and passes on one row a
    block, whatever the number of tickets.  The work goes by tickets, so equal
    ones should be left out before.
    """

    def run(batches):
        bits = np.zeros(-(-comb(n, k) // BITS) * BITS, bool)
        table = binomials(n, k)
        for batch in batches:
            flat = batch.column(0)
            numbers = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), k)
            for main in np.unique(numbers, axis=0):
                bits[_support(main, n, k, least, table)] = True
        for block in range(len(bits) // BITS):
            part = bits[block * BITS : (block + 1) * BITS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["block", "reached"])

    made = tickets.select("main").mapInArrow(run, "block bigint, reached binary")
    return made.groupBy("block").agg(F.bitmap_or_agg("reached").alias("reached"))


def _support(main: np.ndarray, n: int, k: int, least: int, table: np.ndarray) -> np.ndarray:
    """The outcomes that share ``least`` numbers or more with a ticket."""
    others = np.setdiff1d(np.arange(1, n + 1), main)
    out = []
    for hits in range(max(least, 2 * k - n), k + 1):
        mine = np.array(list(combinations(main, hits)), np.int64).reshape(comb(k, hits), hits)
        rest = others[np.array(list(combinations(range(n - k), k - hits)), np.int64).reshape(comb(n - k, k - hits), k - hits)]
        both = np.concatenate([np.repeat(mine, len(rest), 0), np.tile(rest, (len(mine), 1))], 1)
        out.append(table[np.sort(both, 1) - 1, np.arange(1, k + 1)].sum(1))
    return np.concatenate(out)


def ways(n: int, k: int, least: int) -> int:
    """Outcomes in which one ticket has ``least`` hits or more."""
    return sum(comb(k, h) * comb(n - k, k - h) for h in range(least, k + 1))


def exact_union(tickets: DataFrame, n: int, k: int, least: int) -> DataFrame:
    """(outcomes, reached, wins, chance, expected): over the whole universe, in how many outcomes some ticket has ``least`` hits or more, the wins of all tickets, the chance of any and the wins to expect.

    Nothing is assumed about the tickets: those that overlap reach fewer
    outcomes than they have ways to win.  Tickets may repeat; each counts as a
    win.  No tickets reach nothing.
    """
    # equal tickets reach the same outcomes: their outcomes are worked out once, for C(n, k) different tickets at most
    different = tickets.where("main is not null").groupBy(F.array_sort(F.col("main").cast("array<bigint>")).alias("main")).agg(F.count(F.lit(1)).alias("c"))
    held = different.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tickets"))
    union = reached(different.where("c > 0"), n, k, least)  # true of all; it keeps the count, so that both take the same aggregate and the tickets are read once
    covered = union.agg(F.coalesce(F.sum(F.bitmap_count("reached")), F.lit(0)).cast("bigint").alias("reached"))
    total, each = F.lit(comb(n, k)).cast("bigint"), ways(n, k, least)
    row = covered.crossJoin(F.broadcast(held))  # one row each
    return row.select(
        total.alias("outcomes"), "reached", (F.col("tickets") * each).cast("bigint").alias("wins"), F.round(F.col("reached") / total, 9).alias("chance"), F.round(F.col("tickets") * each / total, 9).alias("expected")
    )


def running_counts(counts: DataFrame, value: str, ranges: int = 256) -> DataFrame:
    """(value, c, upto, everything): running sums of ``c`` along distinct values, by ranges that hold about as many distinct values each.

    The ranges are cut at approximate quantiles of the distinct values, so an
    outlier does not put all others into one task.
    """
    cuts = counts.agg(F.percentile_approx(value, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), ranges * 40).alias("cuts"))
    d = counts.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter(F.array_distinct("cuts"), lambda c: c <= F.col(value)))).drop("cuts")  # one row
    per = d.groupBy("_range").agg(F.sum("c").alias("_in"))
    w = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = per.select("_range", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(F.lit(0))).alias("everything"))
    within = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(F.broadcast(before), "_range").select(value, "c", (F.sum("c").over(within) + F.col("_before")).alias("upto"), "everything")


def midrank_quantile(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(..., score, quantile): the mid-rank (count below + count up to) / 2M of each asked score among the ``c`` outcomes of each score."""
    table = running_counts(counts, "score").select("score", F.round((2 * F.col("upto") - F.col("c")) / (2 * F.col("everything")), 9).alias("quantile"))
    return asked.join(table, "score")
