"""Greedy pruning, forecasts and fits on small fixtures; earlier rows do not change with later draws."""

from pyspark.sql import functions as F

from drawloom.operators import backtests, features, models, series
from drawloom.plans import bridge

SF = "/root/testdata/sf0.001"


def test_prune_keeps_strategies_and_the_cap(spark):
    rows = [(1, 1, "a", 0.9, [1, 2, 3, 4]), (1, 2, "a", 0.8, [1, 2, 3, 5]), (1, 3, "b", 0.7, [1, 2, 3, 6]), (1, 4, "a", 0.6, [7, 8, 9, 10]), (1, 5, "a", 0.5, [11, 12, 13, 14]), (2, 6, "a", 0.1, [1, 2, 3, 4])]
    df = spark.createDataFrame(rows, "batch long, ticket_id long, strategy string, score double, main array<long>")
    got = {r.ticket_id: (r.kept, r.reason) for r in backtests.prune_overlap(df, 2, F.lit(3)).collect()}
    assert got == {1: (True, "floor"), 2: (False, "overlap"), 3: (True, "floor"), 4: (True, "fits"), 5: (False, "target"), 6: (True, "floor")}


def test_nothing_looks_ahead(spark):
    draws = bridge.draws(spark, SF).where("lottery = 'g1'")
    changed = draws.withColumn("front", F.when(F.col("issue_year") >= 2000, F.array(*(F.lit(i).cast("bigint") for i in range(1, 7)))).otherwise(F.col("front")))
    for make in (lambda d: series.strategy_hot(d, 33, 30, 6), lambda d: series.strategy_overdue(d, 33, 6), lambda d: backtests.strategy_balanced(d, 33, 30, 6), lambda d: features.feature_matrix_v1(d, 33, 100).drop("label")):
        early = draws.where("issue_year < 2000").count()
        key = lambda d: sorted(map(str, make(d).where(F.col("ord") <= early).collect()))
        assert key(draws) == key(changed)


def test_universe_and_midranks(spark):
    u = backtests.combination_universe(spark, 7, 3)
    assert u.count() == 35 == u.select(F.array_join("numbers", "-")).distinct().count()
    scores = u.select(F.aggregate("numbers", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("score"))
    got = {r.score: r.quantile for r in backtests.midrank_quantile(scores, spark.createDataFrame([(6,), (12,), (18,)], "score long")).collect()}
    assert abs(got[6] - 1 / 70) < 1e-9 and abs(got[12] - 0.5) < 1e-9 and abs(got[18] - 69 / 70) < 1e-9


def test_popularity_finds_an_injected_effect(spark):
    frame = models.popularity_frame(bridge.draws(spark, SF))
    centred = frame.withColumn("offset", F.lit(3.0)).withColumn("winners", F.round(F.exp(F.lit(3.0) + (F.col("share12") - 0.35) * 2)))
    fit = {r.feature: r for r in models.fit_popularity(centred).collect()}
    others = max(abs(fit[n].beta) for n in models.POPULARITY if n != "share12")
    assert fit["share12"].beta > 0.2 and fit["share12"].beta > 4 * others and fit["share12"].p < 1e-6


def test_heat_finds_positions(spark):
    df = bridge.series(spark, SF).withColumn("winners1", F.when(F.get("digits", F.lit(2)) == 7, 20).otherwise(3))
    heat = {(r.position, r.digit): r.heat for r in models.position_heat(df).collect()}
    assert heat[2, 7] > 1.4 and abs(heat[1, 7]) < 0.2
