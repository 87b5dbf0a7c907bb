"""Replicates in parts against permutations done one by one."""

from hashlib import md5
from itertools import accumulate, groupby

from pyspark.sql import functions as F

from drawloom.operators import significance as sg


def _orders(values, B, seed):
    return [values] + [[values[o - 1] for o in sorted(range(1, len(values) + 1), key=lambda o: md5(f"{seed}:{b}:{o}".encode()).hexdigest())] for b in range(1, B + 1)]


def test_runs_and_sums_over_parts_equal_whole_orders(spark):
    x = [1 + i * i % 7 % 3 if i % 400 > 9 else 1 for i in range(6000)]
    x[2040:2060] = [3] * 20  # over the end of a part
    draws = spark.createDataFrame([("a", 2001, i + 1, [v], 100 * v) for i, v in enumerate(x)], "lottery string, issue_year long, issue_seq long, back array<int>, sales long")
    got = sg.longest_run(draws, 5, 7).first()
    runs = [max(len(list(g)) for _, g in groupby(o)) for o in _orders(x, 5, 7)]
    assert (got.observed, got.replicates, got.reached) == (runs[0], 5, sum(r >= runs[0] for r in runs[1:])) and runs[0] >= 20
    got = sg.cusum(draws, spark.createDataFrame([("a", 150.0)], "lottery string, middle double"), 5, 7).first()
    most = [max(map(abs, accumulate(o))) for o in _orders([1 if v > 1 else -1 for v in x], 5, 7)]
    assert (got.observed, got.reached) == (most[0], sum(m >= most[0] for m in most[1:]))
    longest, mean = [sg.permute_null(spark.createDataFrame([("a", i, v) for i, v in enumerate(z)], "lottery string, replicate int, v int"), ["lottery"], "v").first() for z in (runs, most)]
    assert got.q99 == mean.q99 and sg.longest_run(draws, 5, 7).first().q95 == longest.q95


def test_no_replicate_is_one_part(spark):
    s = spark.range(1, 20_001).select(F.lit("a").alias("lottery"), F.col("id").alias("ord"), F.lit(1).alias("x"))
    sizes = sg.replicate_parts(s, "ord", 3, 7).groupBy("replicate", "part").count().groupBy("replicate").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    assert len(sizes) == 4 and all(r.n == 20_000 and r.most <= 2048 for r in sizes)
