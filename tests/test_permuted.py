"""Permuted orders in packed parts against orders sorted whole by their MD5."""

from hashlib import md5
from itertools import accumulate, groupby

import numpy as np
from pyspark.sql import functions as F

from drawloom.functions.digests import md5_numbered
from drawloom.operators import permuted as pm
from drawloom.operators import significance as sg


def test_digests_of_numbers_are_those_of_their_texts():
    numbers = np.array([0, 9, 10, 99, 999_999_999, 2**32 - 1, 2**32, 10**18, 2**63 - 1, *range(95, 20_000)])
    for prefix in (b"", b"7:1:", b"-123456:39:", b"x" * 36):
        first, last = md5_numbered(prefix, numbers)
        assert [f"{a:016x}{b:016x}" for a, b in zip(first.tolist(), last.tolist(), strict=True)] == [md5(prefix + str(n).encode()).hexdigest() for n in numbers.tolist()]


def _order(values, replicate):
    return [values[o - 1] for o in sorted(range(1, len(values) + 1), key=lambda o: md5(f"7:{replicate}:{o}".encode()).hexdigest())]


def test_several_parts_equal_whole_orders(spark):
    n, B = 290_000, 2  # five chunks: two parts a replicate
    x = [None if i % 5 == 0 else -300 if 131_000 < i < 131_090 else i * i % 11 % 4 for i in range(1, n + 1)]
    value = F.expr("case when id % 5 = 0 then null when id > 131000 and id < 131090 then -300 else id * id % 11 % 4 end").cast("int")
    series = spark.range(1, n + 1).select(F.lit("a").alias("lottery"), F.col("id").alias("ord"), value.alias("x"))
    cells = pm.packed_parts(series, B, 7).select("replicate", "part", F.length("at").alias("at"), (F.length("x") / F.col("width")).alias("rows"), (F.length("at") + F.length("x")).alias("bytes")).collect()
    for r in range(B + 1):
        parts = {}
        for c in cells:
            if c.replicate == r:
                assert c.at == 2 * c.rows
                parts[c.part] = parts.get(c.part, 0) + c.rows
        assert len(parts) == (5 if r == 0 else 2) and sum(parts.values()) == n and max(parts.values()) < 1.1 * pm.CHUNK * pm.CHUNKS_A_PART
    draws = series.select("lottery", F.lit(2001).alias("issue_year"), F.col("ord").alias("issue_seq"), F.array("x").alias("back"), F.when(F.col("x") > 1, 200).otherwise(F.col("x")).alias("sales"))
    orders = [x, *(_order(x, b) for b in range(1, B + 1))]
    runs = [max(1 if v is None else len(list(g)) for v, g in groupby(o)) for o in orders]
    got = sg.longest_run(draws, B, 7).first()
    assert (got.observed, got.replicates, got.reached) == (runs[0], B, sum(r >= runs[0] for r in runs[1:]))
    assert got.q99 == np.round(np.quantile(runs[1:], 0.99), 6)
    sums = [max(map(abs, accumulate(1 if v is not None and v > 1 else -1 for v in o))) for o in orders]
    got = sg.cusum(draws, spark.createDataFrame([("a", 150.0)], "lottery string, middle double"), B, 7).first()
    assert (got.observed, got.reached, got.q95) == (sums[0], sum(s >= sums[0] for s in sums[1:]), np.round(np.quantile(sums[1:], 0.95), 6))


def test_replicates_shuffle_few_bytes_a_row(spark):
    draws = spark.range(1, 30_001).select(F.lit("a").alias("lottery"), F.lit(2001).alias("issue_year"), F.col("id").alias("issue_seq"), F.array((F.col("id") % 16).cast("int")).alias("back"))
    plan = sg.longest_run(draws, 39)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan  # no row a draw and replicate
    cells = pm.packed_parts(draws.select("lottery", F.col("issue_seq").alias("ord"), F.col("back")[0].alias("x")), 39, 7)
    assert cells.agg(F.sum(F.length("at") + F.length("x"))).first()[0] == 3 * 40 * 30_000


def test_no_draws_give_no_rows(spark):
    none = spark.createDataFrame([], "lottery string, issue_year int, issue_seq long, back array<int>, sales long")
    assert sg.longest_run(none, 3).count() == 0
    assert sg.cusum(none, spark.createDataFrame([], "lottery string, middle double"), 3).count() == 0
