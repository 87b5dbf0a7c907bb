"""Resampling in one pass: replicates are weights or signs that a row's own number gives, never copies of the row.

A task turns its rows into arrays with an entry a replicate and adds them up;
what is shuffled is one row a game and task.  The same rows give the same
replicates on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp, factorial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import STRETCH

#: Rows that meet all replicates at once.
ROWS = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(ord_: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A number in [0, 1) for each row and replicate, from the row's number, the replicate and the seed alone."""
    r = _mixed(np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    x = _mixed(_mixed(ord_.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None] ^ r[None, :])
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53


def poisson_weights(ord_: np.ndarray, rate: float, replicates: int, seed: int) -> np.ndarray:
    """How often each row is drawn in each replicate of a bootstrap, as Poisson numbers of mean ``rate``."""
    u, top = uniforms(ord_, replicates, seed), int(rate + 12 * max(rate, 1.0) ** 0.5 + 4)
    steps = np.cumsum([exp(-rate) * rate**i / factorial(i) for i in range(top)])
    return np.searchsorted(steps, u, side="right").astype(np.float64)


def _replicate_sums(rows: DataFrame, columns: int, replicates: int, each) -> DataFrame:
    """(lottery, replicate, s0, s1, ...): ``each(numbers, values)`` -> (columns, replicates) sums, added up over tasks."""
    names = [f"s{i}" for i in range(columns)]

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            games, at = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            values = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(2, batch.num_columns)]
            for g in np.unique(games):
                mine = np.flatnonzero(games == g)
                for lo in range(0, len(mine), ROWS):
                    r = mine[lo : lo + ROWS]
                    sums[g] = sums.get(g, 0) + each(at[r], [v[r] for v in values])
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * replicates, pa.string()), pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(c) for c in s)], ["lottery", "replicate", *names])

    made = rows.mapInArrow(run, "lottery string, replicate int, " + ", ".join(f"{n} double" for n in names))
    return made.groupBy("lottery", "replicate").agg(*(F.sum(n).alias(n) for n in names))


def block_sums(series: DataFrame, block: int) -> DataFrame:
    """(lottery, ord, x, n): for each draw the sum and number of x over it and the ``block`` - 1 draws after it, within stretches that look ahead.

    ``series`` has lottery, ord (without gaps or with) and x.
    """
    own = F.floor(F.col("ord") / STRETCH)
    d = series.where("x is not null").withColumn("_s", F.explode(F.sequence(F.floor((F.col("ord") - block + 1) / STRETCH), own)))
    w = Window.partitionBy("lottery", "_s").orderBy("ord").rangeBetween(0, block - 1)
    return d.select("lottery", "_s", "ord", F.sum("x").over(w).alias("x"), F.count("x").over(w).cast("double").alias("n")).where(F.col("_s") == own).select("lottery", "ord", "x", "n")


def block_means(series: DataFrame, block: int, replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(lottery, n, mean, se, lo, hi): the mean of x with the standard error and interval of a moving-block bootstrap.

    Every draw starts a block with a Poisson number of copies, once in
    ``block`` on average; a replicate's mean is the blocks' sums over their
    lengths.  Null x are left out; a game without x has no row.
    """
    made = _replicate_sums(block_sums(series, block).select("lottery", "ord", "x", "n"), 2, replicates, lambda at, v: np.stack([v[0], v[1]]) @ poisson_weights(at, 1 / block, replicates, seed))
    reps = made.where("s1 > 0").select("lottery", (F.col("s0") / F.col("s1")).alias("m"))
    tails = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))  # ``replicates`` rows a game
    spread = reps.groupBy("lottery").agg(F.stddev("m").alias("se"), tails.alias("q"))
    total = series.where("x is not null").groupBy("lottery").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))
    return total.join(spread, "lottery", "left").select("lottery", "n", "mean", "se", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def sign_flips(series: DataFrame, replicates: int = 2000, seed: int = 1) -> DataFrame:
    """(lottery, total, p): the sum of x and how often random signs of its rows give as much, one-sided, the observed one counted."""
    made = _replicate_sums(series.where("x is not null").select("lottery", "ord", "x"), 1, replicates, lambda at, v: (v[0] @ np.where(uniforms(at, replicates, seed) < 0.5, -1.0, 1.0))[None, :])
    total = series.groupBy("lottery").agg(F.sum("x").alias("total"))
    reached = made.join(F.broadcast(total), "lottery").groupBy("lottery", "total").agg(F.count_if(F.col("s0") >= F.col("total") - 1e-12).alias("r"), F.count(F.lit(1)).alias("b"))  # one row a game
    return reached.select("lottery", "total", ((F.col("r") + 1) / (F.col("b") + 1)).alias("p"))


# ---------------------------------------------------------------------------
# Permutations: of a series whose rows are exchangeable, a random order depends
# on nothing but how often each value occurs.
# ---------------------------------------------------------------------------

#: Values of a permuted series that are made at once.
CHUNK = 65_536


def arrangement(counts: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """A uniformly random order of counts[i] values i, a chunk at a time: what a chunk takes of each value is hypergeometric in what is left."""
    left = np.array(counts, np.int64)
    while (total := int(left.sum())) > 0:
        size = min(CHUNK, total)
        take = rng.multivariate_hypergeometric(left, size, method="marginals")
        part = np.repeat(np.arange(len(left)), take)
        rng.shuffle(part)
        left -= take
        yield part


def longest_of(parts: Iterator[np.ndarray]) -> int:
    """The longest run of equal values in a series that comes in parts."""
    best = run = 0
    last = None
    for p in parts:
        edges = np.flatnonzero(np.diff(p)) + 1
        bounds = np.concatenate([[0], edges, [len(p)]])
        sizes = np.diff(bounds)
        if p[0] == last:
            sizes[0] += run
        best, run, last = max(best, int(sizes.max())), int(sizes[-1]), p[-1]
    return best


def furthest_of(parts: Iterator[np.ndarray], steps: np.ndarray) -> float:
    """The largest absolute partial sum of steps[value] along a series that comes in parts."""
    most = at = 0.0
    for p in parts:
        sums = at + np.cumsum(steps[p])
        most, at = max(most, float(np.abs(sums).max())), float(sums[-1])
    return most


def permutation_null(counts: DataFrame, statistic: Callable[[Iterator[np.ndarray], list], float], replicates: int, seed: int = 7) -> DataFrame:
    """(lottery, replicate, value): ``statistic(parts, values)`` of random orders of each game's values.

    ``counts`` has lottery, value and n.  Only the counts reach the tasks, and a
    task makes one replicate at a time in chunks: no row is copied or shuffled
    per replicate, and none has to fit in memory.  A replicate depends on the
    seed, its number, the game and its counts alone.
    """
    games = counts.groupBy("lottery").agg(F.array_sort(F.collect_list(F.struct("value", F.col("n").cast("bigint").alias("n")))).alias("c"))  # one entry a value
    each = games.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select("lottery", "replicate", F.col("c.value").alias("values"), F.col("c.n").alias("n"))
    spread = each.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lottery", "replicate")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [float(statistic(arrangement(np.array(r["n"]), np.random.default_rng([seed, r["replicate"], crc32(r["lottery"].encode())])), r["values"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64())], ["lottery", "replicate", "value"])

    return spread.mapInArrow(run, "lottery string, replicate int, value double")


def against_null(observed: DataFrame, null: DataFrame) -> DataFrame:
    """(lottery, observed, replicates, reached, p, q95, q99): p = (1 + replicates at least as large) / (1 + replicates)."""
    met = null.join(F.broadcast(observed.select("lottery", F.col("value").alias("observed"))), "lottery")  # one row a game
    g = met.groupBy("lottery", "observed").agg(F.count(F.lit(1)).alias("replicates"), F.count_if(F.col("value") >= F.col("observed") - 1e-12).alias("reached"), F.percentile("value", F.array(F.lit(0.95), F.lit(0.99))).alias("q"))
    return g.select("lottery", "observed", "replicates", "reached", ((F.col("reached") + 1) / (F.col("replicates") + 1)).alias("p"), F.col("q")[0].alias("q95"), F.col("q")[1].alias("q99"))


def _by_stretch(series: DataFrame) -> DataFrame:
    return series.withColumn("stretch", F.expr(f"(ord - 1) div {STRETCH}"))


def observed_run(series: DataFrame) -> DataFrame:
    """(lottery, value): the longest run of equal x along ord; runs that go on over stretches are put together from one row a stretch."""
    w = Window.partitionBy("lottery", "stretch").orderBy("ord")
    d = _by_stretch(series).withColumn("new", F.coalesce((F.col("x") != F.lag("x").over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    runs = d.groupBy("lottery", "stretch", "run").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"))
    size = Window.partitionBy("lottery", "stretch")
    runs = runs.withColumn("last", F.col("run") == F.max("run").over(size))
    inner = runs.groupBy("lottery").agg(F.max("n").alias("inner"))
    # only first and last runs of stretches can go on: two rows a stretch
    ends = runs.where("run = 1 or last")
    over = Window.partitionBy("lottery").orderBy("stretch", "run")
    joined = ends.withColumn("starts", F.coalesce(~((F.lag("x").over(over) == F.col("x")) & (F.col("run") == 1) & (F.lag("stretch").over(over) == F.col("stretch") - 1)), F.lit(True)).cast("int")).withColumn("chain", F.sum("starts").over(over))
    long = joined.groupBy("lottery", "chain").agg(F.sum("n").alias("n")).groupBy("lottery").agg(F.max("n").alias("outer"))
    return inner.join(long, "lottery").select("lottery", F.greatest("inner", "outer").cast("double").alias("value"))


def observed_reach(series: DataFrame) -> DataFrame:
    """(lottery, value): the largest absolute partial sum of x along ord, carried over stretches by one row each."""
    w = Window.partitionBy("lottery", "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    d = _by_stretch(series).withColumn("s", F.sum("x").over(w))
    per = d.groupBy("lottery", "stretch").agg(F.sum("x").alias("sum"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("lottery").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a stretch
    far = per.select("lottery", F.greatest(F.abs(F.col("lo") + before), F.abs(F.col("hi") + before)).alias("v"))
    return far.groupBy("lottery").agg(F.max("v").cast("double").alias("value"))


def run_test(series: DataFrame, replicates: int = 999, seed: int = 7) -> DataFrame:
    """The longest run of equal x (lottery, ord, x) against random orders of the same values."""
    null = permutation_null(series.groupBy("lottery", F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("n")), lambda parts, values: longest_of(parts), replicates, seed)
    return against_null(observed_run(series), null)


def cusum_test(series: DataFrame, replicates: int = 999, seed: int = 7) -> DataFrame:
    """The largest absolute partial sum of x (lottery, ord, x; few different values) against random orders of the same values."""
    null = permutation_null(series.groupBy("lottery", F.col("x").alias("value")).agg(F.count(F.lit(1)).alias("n")), lambda parts, values: furthest_of(parts, np.array(values, np.float64)), replicates, seed)
    return against_null(observed_reach(series), null)
