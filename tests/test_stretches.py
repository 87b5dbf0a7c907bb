"""Work done over the stretches of a game's draws: the same as plain loops, and no frame that is summed up again for every draw."""

import random
import re

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from drawloom.operators import backtests as bt
from drawloom.operators import audit, features, models, series


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_commonest_digit_by_running_counts(spark):
    rng = random.Random(3)
    rows = [(g, 2000 + i // 1000, i % 1000 + 1, [rng.choice([0, 1, 2, 3, 9, None]) for _ in range(5)] if i % 7 else None) for g, n in (("a", 2300), ("b", 31), ("c", 12)) for i in range(n)]
    got = bt.rolling_mode(spark.createDataFrame(rows, "lottery string, issue_year int, issue_seq int, digits array<int>"), 30)
    want = {}
    for game in "ab":
        digits = [r[3] or [None] * 5 for r in rows if r[0] == game]
        for p in range(5):
            hits = 0
            for i in range(30, len(digits)):
                before = [d[p] for d in digits[i - 30 : i]]
                hits += digits[i][p] == min(range(10), key=lambda v: (-before.count(v), v))
            want[game, p] = (len(digits) - 30, hits)
    assert {(r.lottery, r.pos): (r.n, r.hits) for r in got.collect()} == want
    assert "RowFrame, -30" not in _plan(got)


def _draws(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(g, 2000 + i // 1000, i % 1000 + 1, sorted(rng.sample(range(1, 13), 3))) for g, n in (("a", n), ("b", n // 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "lottery string, issue_year int, issue_seq int, front array<bigint>")


def test_strategies_by_one_pass(spark):
    rows, draws = _draws(spark, 2600)
    got = {(r.lottery, r.strategy, r.ord): r.hits for r in series.strategy_hits(draws, 12, 3, {"hot5": 5, "hot9": 9}, "late").collect()}
    want = {}
    for game in "ab":
        fronts = [r[3] for r in rows if r[0] == game]
        last = dict.fromkeys(range(1, 13), 0)
        for i, front in enumerate(fronts):
            for name, width in (("hot5", 5), ("hot9", 9)):
                before = [x for f in fronts[max(i - width, 0) : i] for x in f]
                picks = sorted(range(1, 13), key=lambda x: (-before.count(x), x))[:3]
                want[game, name, i + 1] = len(set(picks) & set(front))
            picks = sorted(range(1, 13), key=lambda x: (last[x], x))[:3]
            want[game, "late", i + 1] = len(set(picks) & set(front))
            last |= dict.fromkeys(front, i + 1)
    assert got == want


def test_windows_of_all_draws_come_without_a_window_per_number(spark):
    _, draws = _draws(spark, 60)
    assert _plan(features.feature_matrix_v2(draws, 12, 30)).count("lag(") == 0


def test_chances_of_numbers_from_cells(spark):
    _, draws = _draws(spark, 400)
    made = features.number_cells(draws, 12, 10)
    assert made.count() < 2 * 4 * 11 * 11 * 2
    got = {r.fold: (r.n, r.auc) for r in models.number_model(made.where("lottery = 'a'")).collect()}
    matrix = features.feature_matrix_v1(draws.where("lottery = 'a'"), 12, 10)
    d = matrix.select("ord", F.explode(F.arrays_zip("freq", "gap", "label")).alias("x")).select("ord", array_to_vector(F.array("x.freq", "x.gap")).alias("features"), F.col("x.label").cast("double").alias("label")).cache()
    for k in (1, 2, 3):
        cut, upto = 11 + 390 / 4 * k, 11 + 390 / 4 * (k + 1)
        test = LogisticRegression(regParam=1e-4, maxIter=30).fit(d.where(F.col("ord") < cut)).transform(d.where((F.col("ord") >= cut) & (F.col("ord") < upto)))
        assert got[k] == (test.count(), pytest.approx(BinaryClassificationEvaluator(numBins=0).evaluate(test), abs=1e-4))


def test_better_half_without_a_sort_of_all_tickets(spark):
    rng = random.Random(8)
    rows = [(g, w, i, rng.choice([0.1, 0.2, 0.2000001, 5.0, None])) for g, n in (("a", 41), ("b", 1), ("c", 8)) for w in (1, 2, 3) for i in range(n)]
    scored = spark.createDataFrame(rows, "lottery string, window int, ticket_id long, score double")
    place = lambda div: {(g, w, i) for g in "abc" for w in (1, 2, 3) for k, (_, i) in enumerate(sorted(((-99 if r[3] is None else r[3]) * -1, r[2]) for r in rows if r[:2] == (g, w))) if (k + 1) * div <= sum(r[:2] == (g, w) for r in rows)}
    half, quarter = place(2), place(4)
    made = bt.consensus_tier(scored, 0.3, 100)
    got = {(r.lottery, r.ticket_id): (r.half, r.quarter) for r in made.collect()}
    share = lambda kept, g, i: round(sum((g, w, i) in kept for w in (1, 2, 3)) / 3, 6)
    assert got == {(g, i): (share(half, g, i), share(quarter, g, i)) for g in "abc" for i in range(41) if share(half, g, i) >= 0.3}
    assert not re.search(r"score#\d+ DESC NULLS LAST, ticket_id", _plan(made))


def test_batches_of_prefixes_are_not_copied(spark):
    settled = spark.createDataFrame([("evaluated", b, t, t % 3, 0, 5 * (t % 2)) for b in range(4) for t in range(b + 1)], "status string, batch long, ticket_id long, h int, j int, amount long")
    made = bt.prefix_curve(settled, [1, 2])
    assert {r.k: (r.batches, r.cost, r.gross, r.mean_hits, r.rate, r.without_largest) for r in made.collect()} == {1: (4, 8, 0, 0.0, 0.0, 0), 2: (4, 14, 15, round(3 / 7, 6), 0.75, 10)}
    assert "Aggregate [batch#" in _plan(made)  # not by k and batch


def test_feedback_meets_its_draw_without_arrays(spark):
    feedback = spark.sql("SELECT 1L AS ticket_id, 7L AS draw_k, array(1L, 2L) AS main, array(3L) AS bonus, array(2L, 1L) AS front, array(3L) AS back, 2 AS h, 1 AS j, 3 AS total, 6 AS grade, true AS valid, timestamp'2020-01-01' AS generated, CAST(NULL AS DATE) AS predicted, CAST(NULL AS STRING) AS source")
    draws = spark.sql("SELECT 7L AS k, array(1L, 2L) AS front, array(3L) AS back, DATE'2020-01-02' AS draw_date")
    made = audit.audit_feedback(feedback.union(feedback.withColumn("front", F.expr("array(2L, 9L)")).withColumn("ticket_id", F.lit(2).cast("bigint"))), draws)
    assert [tuple(r) for r in made.collect()] == [(2, "numbers")]
    joined = [n for n in _plan(made).splitlines() if "Join LeftOuter" in n and "draw_k" in n]
    assert joined and "_front" in _plan(made) and "array_sort(_front" not in _plan(made)
