"""Universes, walk-forward fits, likelihoods and resampling against plain versions."""

import math
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.functions import scalar
from drawloom.operators import likelihood, models, resampling, universe, walkforward
from drawloom.plans import fitted

DRAWS = "lottery string, k long, issue_year long, issue_seq long, sales long, first_winners long, front array<long>"


def test_numbers_and_outcomes_turn_into_each_other(spark):
    every = np.array(list(combinations(range(1, 10), 4)))
    assert sorted(universe.rank(every, 9)) == list(range(126)) and (universe.unrank(universe.rank(every, 9), 9, 4) == every).all()
    rows = spark.createDataFrame([(c.tolist(), int(i)) for c, i in zip(every, universe.rank(every, 9), strict=True)], "n array<long>, i long")
    assert rows.where(universe.rank_column(F.col("n"), 9, 4) != F.col("i")).count() == 0
    assert sorted((r.outcome, tuple(r.numbers)) for r in universe.outcomes(spark, 9, 4).collect()) == sorted((int(universe.rank(c[None], 9)[0]), tuple(c)) for c in every)


def test_shapes_equal_the_column_expressions(spark):
    rng = np.random.default_rng(1)
    some = np.sort(np.stack([rng.permutation(33)[:6] + 1 for _ in range(300)]), 1)
    got = universe.shapes(some)
    d = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(some)], "i int, n array<long>")
    want = d.select("i", *(scalar.shape_features(F.col("n"))[n].cast("double").alias(n) for n in universe.SHAPES)).orderBy("i").collect()
    assert np.allclose(got, [[r[n] for n in universe.SHAPES] for r in want])


def test_union_equals_enumeration(spark):
    n, k = 10, 4
    tickets = [[1, 2, 3, 4], [1, 2, 3, 5], [7, 8, 9, 10], [1, 2, 3, 4]]
    for least in (0, 2, 3, 4):
        hit = [[len(set(t) & set(o)) >= least for t in tickets] for o in combinations(range(1, n + 1), k)]
        got = universe.exact_union(spark.createDataFrame([(t[::-1],) for t in tickets], "main array<int>"), n, k, least).first()
        assert (got.outcomes, got.reached, got.wins) == (math.comb(n, k), sum(map(any, hit)), sum(map(sum, hit)))
    none = universe.exact_union(spark.createDataFrame([], "main array<int>"), n, k, 3).first()
    assert (none.reached, none.wins) == (0, 0)


def test_union_works_equal_tickets_out_once(spark):
    tickets = spark.range(3000).selectExpr("if(id % 10 = 0, null, if(id % 2 = 0, array(5L, 1L, 2L), array(2L, 1L, 5L))) AS main")
    made = universe.exact_union(tickets, 7, 3, 2)
    row = made.first()
    assert (row.reached, row.wins) == (13, 13 * 2700)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[[^\]]*\], \[", plan[plan.index("MapInArrow") :])  # by ticket, below the work in Python


def test_midranks_with_ties_and_outliers(spark):
    values = [1] * 5 + [2] * 3 + list(range(10, 400)) + [10**12]
    counts = spark.createDataFrame([(v,) for v in values], "score long").groupBy("score").agg(F.count("score").alias("c"))
    got = {r.score: r.quantile for r in universe.midrank_quantile(counts, spark.createDataFrame([(v,) for v in {1, 2, 57, 10**12}], "score long")).collect()}
    assert got == {v: pytest.approx((sum(x < v for x in values) + sum(x <= v for x in values)) / (2 * len(values)), abs=1e-9) for v in got} and len(got) == 4
    parts = universe.running_counts(counts, "score").select("score").rdd.getNumPartitions()
    assert parts >= 1


def _draws(spark, n=260, seed=2, games=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for g in games:
        for i in range(n):
            front = np.sort(rng.permutation(33)[:6] + 1)
            low = (front <= 16).sum()
            rows.append((g, len(rows), 2000 + i // 100, i % 100 + 1, int(2e6), int(rng.poisson(3 * math.exp(0.25 * (low - 3)))), front.tolist()))
    return spark.createDataFrame(rows, DRAWS), rows


def _irls(x, y, offset):
    z = np.concatenate([np.ones((len(x), 1)), x], 1)
    b = np.zeros(z.shape[1])
    b[0] = math.log(y.sum() / np.exp(offset).sum())
    for _ in range(100):
        mu = np.exp(z @ b + offset)
        b = b + np.linalg.solve((z * mu[:, None]).T @ z + 1e-9 * np.eye(len(b)), z.T @ (y - mu))
    return b


def test_fits_of_all_cuts_equal_single_fits(spark):
    draws, rows = _draws(spark)
    frame = walkforward.shape_frame(draws).persist()
    spans = walkforward.expanding_cuts(frame, 150, 40)
    assert {g: s[:, 1].tolist() for g, s in spans.items()} == {g: [151, 191, 231] for g in ("a", "b")}
    fits = walkforward.fit_spans(frame, len(universe.SHAPES), spans)
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g]
        x, y = universe.shapes(np.array([r[6] for r in own])), np.array([r[5] for r in own], float)
        mean, sd = fits.scale[g]
        for (_, cut), beta in zip(fits.spans[g], fits.beta[g], strict=True):
            want = _irls((x[: cut - 1] - mean) / sd, y[: cut - 1], np.full(cut - 1, math.log(1e6)))
            assert np.allclose(beta, want, atol=1e-6)


def test_walk_forward_quantiles_use_the_past_only_and_rank_in_the_universe(spark):
    draws, rows = _draws(spark, games=("a",))
    got = {r.ord: r for r in walkforward.walk_forward_quantiles(draws, 150, 40).collect()}
    assert sorted(got) == list(range(151, 261)) and {r.cut for r in got.values()} == {151, 191, 231}
    changed = draws.withColumn("first_winners", F.when(F.col("k") >= 190, F.lit(50)).otherwise(F.col("first_winners")))
    again = {r.ord: r.u for r in walkforward.walk_forward_quantiles(changed, 150, 40).collect()}
    assert all(again[o] == got[o].u for o in range(151, 231)) and any(again[o] != got[o].u for o in range(231, 261))
    frame = walkforward.shape_frame(draws)
    fits = walkforward.fit_spans(frame, len(universe.SHAPES), walkforward.expanding_cuts(frame, 150, 40))
    mean, sd = fits.scale["a"]
    every = np.rint((((universe.shapes(universe.unrank(np.arange(math.comb(33, 6)), 33, 6)) - mean) / sd) * fits.beta["a"][1, 1:]).sum(1) * 1e9)
    for o in (191, 205, 230):
        mine = np.rint((((universe.shapes(np.array([rows[o - 1][6]])) - mean) / sd) * fits.beta["a"][1, 1:]).sum() * 1e9)
        assert abs(got[o].u - ((every < mine).sum() + (every <= mine).sum()) / (2 * len(every))) < 2e-6
    assert walkforward.walk_forward_quantiles(draws, 260, 40).count() == 0


def test_validation_sees_a_planted_effect_and_no_other(spark):
    frame = walkforward.shape_frame(_draws(spark, n=500)[0])
    real = {r.lottery: r.p for r in walkforward.cross_validation(frame, len(universe.SHAPES)).collect()}
    assert max(real.values()) < 0.05
    shuffled = frame.withColumn("winners", F.col("ord") % 5 + 1.0)
    assert min(r.p for r in walkforward.cross_validation(shuffled, len(universe.SHAPES)).collect()) > 0.05


def test_drift_between_halves(spark):
    draws, _ = _draws(spark, n=400, games=("a",))
    frame = walkforward.shape_frame(draws)
    still = walkforward.halves_drift(frame, len(universe.SHAPES)).first()
    moved = walkforward.halves_drift(frame.withColumn("winners", F.when(F.col("ord") > 200, F.col("winners") * 3).otherwise(F.col("winners"))), len(universe.SHAPES)).first()
    assert still.p > 0.001 and moved.p < 1e-6 and abs(still.ratio - 1) < 0.3 and 2.2 < moved.ratio < 4


HEAT = "lottery string, digits array<int>, sales long, winners1 long, winners2 long"


def test_heat_recovers_planted_shares(spark):
    rng = np.random.default_rng(4)
    pi = rng.dirichlet(np.full(10, 8.0), 3)
    rows = []
    for i in range(3000):
        z = rng.integers(0, 10, 3)
        m = pi[np.arange(3), z]
        q1, q2 = m.prod(), sum((1 - m[j]) * m.prod() / m[j] for j in range(3))
        volume = 40_000 * rng.uniform(0.5, 2)
        rows.append(("a", z.tolist(), int(2 * volume) if i % 4 else None, int(rng.poisson(volume * q1)), int(rng.poisson(volume * 0.7 * q2))))
    got = likelihood.position_heat_poisson(spark.createDataFrame([*rows, ("b", None, 5, 1, 1), ("a", [1, 2], 5, 1, 1), ("a", [1, 2, 3], 5, None, 1)], HEAT), ["winners1", "winners2"], positions=3).collect()
    share = np.zeros((3, 10))
    for r in got:
        share[r.position, r.digit] = r.share
        assert abs(r.score) < 1e-3
    assert len(got) == 30 and np.allclose(share.sum(1), 1) and np.abs(share - pi).max() < 0.003


def test_heat_of_many_winners_has_no_slopes_left(spark):
    rng = np.random.default_rng(6)
    rows = [("a", rng.integers(0, 10, 3).tolist(), 2 * 10**13 if i % 4 else None, int(rng.integers(0, 10**9)), int(rng.integers(10**9, 3 * 10**9))) for i in range(400)]
    got = likelihood.position_heat_poisson(spark.createDataFrame(rows, HEAT), ["winners1", "winners2"], positions=3).collect()
    assert max(abs(r.score) for r in got) < 5e-4


def test_no_filter_on_digits_is_pushed_into_a_join_without_their_columns(spark):
    cells = likelihood.heat_cells(fitted._gaps(spark, "/root/testdata/sf0.001"), ["winners1", "winners2"], 5, 10)
    assert not [x for x in cells._jdf.queryExecution().optimizedPlan().toString().splitlines() if x.lstrip(" :+-|").startswith("!")]


def test_heat_likelihood_slopes_equal_differences():
    rng = np.random.default_rng(5)
    model = likelihood.Heat(3, 4, 2)
    theta = rng.normal(size=model.size) * 0.3
    digits, volume, known, unknown = rng.integers(0, 4, (20, 3)), rng.uniform(10, 90, 20), rng.poisson(4, (20, 2)).astype(float), rng.poisson(2, (20, 2)).astype(float)
    s = model.sums(theta, digits, volume, known, unknown)
    for i in range(model.size):
        e = np.eye(model.size)[i] * 1e-6
        slope = (model.sums(theta + e, digits, volume, known, unknown)[0] - model.sums(theta - e, digits, volume, known, unknown)[0]) / 2e-6
        assert slope == pytest.approx(s[1 + i], rel=1e-4, abs=1e-4)


def _em(x, at, rounds=20_000):
    mu, sigma = x.mean(), x.std()
    for _ in range(rounds):
        z = (at - mu) / sigma
        h = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / np.array([math.erfc(v / math.sqrt(2)) / 2 for v in z])
        first, second = mu + sigma * h, mu * mu + 2 * mu * sigma * h + sigma**2 * (1 + z * h)
        mu, sigma = (x.sum() + first.sum()) / (len(x) + len(at)), None
        sigma = math.sqrt(((x * x).sum() + second.sum()) / (len(x) + len(at)) - mu * mu)
    return mu, sigma


def test_censored_fit_equals_expectation_and_maximisation(spark):
    rng = np.random.default_rng(6)
    true, cap = np.exp(rng.normal(-1.0, 0.8, 800)), np.exp(rng.normal(-0.6, 0.3, 800))
    rows = [("a", float(min(t, c)), bool(t >= c)) for t, c in zip(true, cap, strict=True)]
    extra = [("b", 2.0, True), ("c", 2.0, False), ("d", 1.0, False), ("d", 4.0, False), ("e", -1.0, False), ("e", None, False)]
    got = {r.lottery: r for r in likelihood.censored_lognormal(spark.createDataFrame(rows + extra, "lottery string, x double, capped boolean")).collect()}
    x, at = np.log([v for _, v, c in rows if not c]), np.log([v for _, v, c in rows if c])
    mu, sigma = _em(x, at, 3000)
    assert (got["a"].mu, got["a"].sigma) == (pytest.approx(mu, abs=1e-6), pytest.approx(sigma, abs=1e-6)) and abs(got["a"].mu + 1) < 0.1
    assert (got["b"].mu, got["b"].sigma, got["c"].mu, got["c"].sigma) == (None, None, pytest.approx(math.log(2)), None) and "e" not in got
    assert got["d"].mu == pytest.approx(math.log(2)) and got["d"].sigma == pytest.approx(math.log(2))


def test_block_means_look_like_a_block_bootstrap(spark):
    rng = np.random.default_rng(7)
    noise = rng.normal(size=3000)
    x = np.convolve(noise, np.ones(10) / 10, "same") + 1
    rows = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)], "lottery string, ord long, x double")
    got = resampling.block_means(rows, 30, 800).first()
    starts = rng.integers(0, 3000 - 30, (800, 100))
    sums = np.concatenate([[0], np.cumsum(x)])
    plain = ((sums[starts + 30] - sums[starts]).sum(1) / 3000).std()
    assert got.n == 3000 and got.mean == pytest.approx(x.mean()) and got.se == pytest.approx(plain, rel=0.15)
    assert got.lo < x.mean() < got.hi and got.hi - got.lo == pytest.approx(2 * 1.96 * got.se, rel=0.15)
    assert resampling.block_means(rows.repartition(7), 30, 800).first().se == pytest.approx(got.se)
    sums = resampling.block_sums(rows, 30).orderBy("ord").collect()
    assert [r.n for r in sums[2965:]] == [30.0] * 6 + [float(i) for i in range(29, 0, -1)] and sums[2040].x == pytest.approx(x[2040:2070].sum())


def test_random_numbers_depend_on_the_row_alone():
    u = resampling.uniforms(np.arange(2000), 50, 3)
    assert 0.49 < u.mean() < 0.51 and (u[[5, 9]] == resampling.uniforms(np.array([5, 9]), 50, 3)).all()
    w = resampling.poisson_weights(np.arange(20_000), 0.05, 20, 1)
    assert abs(w.mean() - 0.05) < 0.002 and abs(w.var() - 0.05) < 0.003


def test_arrangements_are_uniform_and_come_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    seen = {}
    for _ in range(6000):
        seen[tuple(np.concatenate(list(resampling.arrangement(np.array([2, 1, 1]), rng))))] = seen.get(tuple(np.concatenate(list(resampling.arrangement(np.array([2, 1, 1]), rng)))), 0) + 1
    assert len(seen) == 12
    monkeypatch.setattr(resampling, "CHUNK", 3)
    parts = list(resampling.arrangement(np.array([4, 3, 1]), rng))
    assert [len(p) for p in parts] == [3, 3, 2] and sorted(np.concatenate(parts)) == [0] * 4 + [1] * 3 + [2]
    counts = np.zeros((8, 3))
    for _ in range(4000):
        whole = np.concatenate(list(resampling.arrangement(np.array([4, 3, 1]), rng)))
        counts[np.arange(8), whole] += 1
    assert np.abs(counts / 4000 - np.array([4, 3, 1]) / 8).max() < 0.04


def test_statistics_of_parts_equal_those_of_the_whole():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.integers(0, 3, 200)
        parts = [p for p in np.split(x, np.sort(rng.integers(0, 200, 5))) if len(p)]
        best = run = 1
        for a, b in zip(x, x[1:], strict=False):
            run = run + 1 if a == b else 1
            best = max(best, run)
        steps = np.array([-1.0, 0.5, 1.0])
        assert resampling.longest_of(iter(parts)) == best and resampling.furthest_of(iter(parts), steps) == pytest.approx(np.abs(np.cumsum(steps[x])).max())


def test_permutation_tests_over_stretches(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, 5000)
    x[2040:2060] = 1  # a run over the edge of a stretch
    rows = spark.createDataFrame([("a", i + 1, int(v)) for i, v in enumerate(x)] + [("b", i + 1, int(v)) for i, v in enumerate(rng.integers(0, 4, 900))], "lottery string, ord long, x int")
    got = {r.lottery: r for r in resampling.run_test(rows, 199).collect()}
    assert got["a"].observed >= 20 and got["a"].p == 1 / 200 and got["b"].p > 0.01 and got["a"].q99 < 12
    signs = rows.withColumn("x", F.when(F.col("x") < 2, -1).otherwise(1))
    plain = {"a": np.abs(np.cumsum(np.where(x < 2, -1, 1))).max()}
    far = {r.lottery: r for r in resampling.cusum_test(signs, 99).collect()}
    assert far["a"].observed == plain["a"] and 0.01 <= far["b"].p <= 1
    again = {r.lottery: r for r in resampling.cusum_test(signs.repartition(5), 99).collect()}
    assert again == far


def test_forecast_holds_its_draws_in_few_partitions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, *(float(x) for x in rng.uniform(12, 18, 5)), int(rng.integers(9)), int(rng.integers(9)), 1 + i % 7, 1 + i % 12) for i in range(400)]
    lags = spark.createDataFrame(rows, "ord long, log_sales double, lag1 double, lag2 double, ma4 double, ma8 double, dry long, wins8 long, weekday long, month long")
    fit, seen = models.GBTRegressor.fit, []
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, train: seen.append((train.rdd.getNumPartitions(), train.storageLevel.useMemory)) or fit(self, train))
    got = {r.model: (r.r2, r.mae) for r in models.forecast_sales(lags.repartition(40), trees=2).collect()}
    label, lag1, cut = np.array([r[1] for r in rows]), np.log1p([r[2] for r in rows]), 399 - 399 * 0.2
    old = np.arange(400) <= cut
    test, mean = label[~old], label[old].mean()
    score = lambda p: pytest.approx((1 - ((test - p) ** 2).sum() / ((test - test.mean()) ** 2).sum(), np.abs(test - p).mean()))
    assert got["mean"] == score(mean) and got["before"] == score(lag1[~old]) and set(got) == {"trees", "mean", "before"}
    assert seen == [(spark.sparkContext.defaultParallelism, True)]
