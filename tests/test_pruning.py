"""Compression of batches against a choice one by one."""

import random

from pyspark.sql import functions as F

from drawloom.operators import pruning


def _plain(rows, cap, target, quality=0.8):
    rows = sorted(set(rows), key=lambda r: (-r[1], r[0], r[2]))
    if len(rows) <= max(3, target):
        return {r[0]: "whole" for r in rows}
    scores = sorted(r[1] for r in rows)
    n = len(scores)
    line = round((scores[n // 2] + scores[(n - 1) // 2]) / 2 * quality, 9)
    taken, why = [], {}
    for i, s, nums in rows:
        if s < line:
            why[i] = "quality"
        elif len(taken) >= target:
            why[i] = "target"
        elif nums in taken:
            why[i] = "duplicate"
        elif any(len(set(nums) & set(t)) > cap for t in taken):
            why[i] = "overlap"
        else:
            taken.append(nums)
            why[i] = "fits"
    for i, _, nums in rows:
        if len(taken) < target and nums not in taken:
            taken.append(nums)
            why[i] = "filled"
    return why


def _made(seed, batches):
    rng = random.Random(seed)
    rows = []
    for b, (n, high) in enumerate(batches):
        for i in range(n):
            rows.append((b, i, round(rng.choice([0.1, 0.2, 0.5, 0.9]) + rng.random() / 10, 2), sorted(rng.sample(range(1, high + 1), 6))))
    return rows


def test_compress_equals_the_plain_choice(spark):
    rows = _made(1, [(2, 33), (9, 12), (40, 16), (400, 33), (1500, 33)])
    df = spark.createDataFrame(rows, "batch long, ticket_id long, score double, main array<long>").repartition(5)
    got = {(r.batch, r.ticket_id): r.reason for r in pruning.compress(df, 2, F.lit(30)).collect()}
    for b in range(5):
        own = [(i, s, tuple(m)) for x, i, s, m in rows if x == b]
        assert {i: got[b, i] for i, _, _ in own} == _plain(own, 2, 30)


def test_one_large_batch_keeps_no_two_that_overlap(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.random(), sorted(rng.sample(range(1, 34), 6))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "batch long, ticket_id long, score double, main array<long>").repartition(8)
    out = pruning.compress(df, 2, F.lit(1000)).collect()
    why = {r.ticket_id: r.reason for r in out}
    assert why == _plain([(i, s, tuple(m)) for _, i, s, m in rows], 2, 1000)
    assert sum(r.kept for r in out) == 1000


def test_small_batches_write_no_subsets(spark, monkeypatch):
    monkeypatch.setattr(pruning, "independent", None)
    rows = _made(3, [(2, 33), (50, 12), (300, 33)])
    df = spark.createDataFrame(rows, "batch long, ticket_id long, score double, main array<long>").repartition(3)
    got = {(r.batch, r.ticket_id): r.reason for r in pruning.compress(df, 2, F.lit(24)).collect()}
    for b in range(3):
        own = [(i, s, tuple(m)) for x, i, s, m in rows if x == b]
        assert {i: got[b, i] for i, _, _ in own} == _plain(own, 2, 24)


def test_small_batches_equal_those_in_rounds(spark, monkeypatch):
    rows = _made(4, [(1, 33), (3, 33), (24, 33), (90, 9), (300, 20), (300, 33)])
    df = spark.createDataFrame([*rows, (7, 1, None, None), (7, 2, 0.5, [1, 2]), (7, 3, 0.0, [3]), (7, 4, -0.0, [3])], "batch long, ticket_id long, score double, main array<long>")
    for target in (None, F.lit(24)):
        few = sorted(map(tuple, pruning.compress(df, 2, target).collect()))
        with monkeypatch.context() as m:
            m.setattr(pruning, "SMALL", 0)
            assert few == sorted(map(tuple, pruning.compress(df, 2, target).collect()))


def test_edges(spark):
    schema = "batch long, ticket_id long, score double, main array<long>"
    assert pruning.compress(spark.createDataFrame([], schema), 2).count() == 0
    rows = [(1, i, None if i % 2 else float("nan"), [1, 2, 3, 4, 5, 6]) for i in range(5)] * 2  # without scores, repeated
    got = {r.ticket_id: r.reason for r in pruning.compress(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {0: "fits", **{i: "duplicate" for i in range(1, 5)}}
    few = spark.createDataFrame([(1, i, 1.0, [i, i + 1]) for i in range(1, 8)], schema)  # too few numbers to conflict
    assert pruning.compress(few, 2, F.lit(6)).where("reason = 'fits'").count() == 6
