"""Tail probabilities against published values and identities."""

import math

import pytest
from pyspark.sql import functions as F

from drawloom.functions import special
from drawloom.operators import audit, prizes, significance


@pytest.mark.parametrize(
    "got,want",
    [
        (special.normal_sf(1.959963984540054), 0.025),
        (special.chi2_tail(3.841458820694124, 1), 0.05),
        (special.chi2_tail(18.307038053275146, 10), 0.05),
        (special.chi2_tail(46.19425952027847, 32), 0.05),
        (special.chi2_tail(300.0, 256), math.fsum(math.exp(k * math.log(150) - 150 - math.lgamma(k + 1)) for k in range(128))),
        (special.t_tail(2.2281388519649385, 10), 0.05),
        (special.t_tail(12.706204736432095, 1), 0.05),
        (special.binomial_cdf(3, 10, 0.5), 176 / 1024),
        (special.binomial_two_sided(2, 10, 0.5), 112 / 1024),
        (special.beta_quantile(0.05, 1, 1), 0.05),
        (special.beta_quantile(0.05, 8, 3), 0.4930987),
        (special.noncentral_chi2_tail(3.841458820694124, 1, 0), 0.05),
        (special.noncentral_chi2_tail(3.841458820694124, 1, 7.848861), 0.8),
        (special.chi2_quantile(0.95, 10), 18.307038053275146),
        (special.shared_prize(100.0, 1.0, 1e9), 100 * (1 - math.exp(-1))),
        (special.shared_prize(100.0, 0.0, 30.0), 30.0),
    ],
)
def test_values(got, want):
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([(3.841458820694124, 1.0), (None, 1.0)], "x double, d double")
    assert [None if r.p is None else round(r.p, 6) for r in df.select(special.chi2_sf("x", "d").alias("p")).collect()] == [0.05, None]


def _series(spark, n, back):
    rows = [("g1", 2000 + i // 100, i % 100 + 1, [int(x) for x in back(i)]) for i in range(n)]
    return spark.createDataFrame(rows, "lottery string, issue_year long, issue_seq long, back array<long>")


def test_nulls_tell_sticky_from_even_series(spark):
    even = _series(spark, 300, lambda i: [(i * 7919 + i * i * 31) % 16 + 1])
    sticky = _series(spark, 300, lambda i: [i // 10 % 16 + 1])
    p = lambda d: significance.longest_run(d, 99).first()
    assert p(sticky).p == 0.01 and p(sticky).out_of_gate and p(even).p > 0.05


def test_change_point_is_found(spark):
    row = significance.change_point(_series(spark, 400, lambda i: [i % 4 + 1 if i < 180 else i % 4 + 9]), 16, 50).first()
    assert row.split == 180 and row.practical


def test_information_of_a_cycle(spark):
    got = {r.lag: r.nats for r in significance.mutual_information(_series(spark, 400, lambda i: [i % 4 + 1]), 2).collect()}
    assert got[1] == pytest.approx(math.log(4), abs=1e-3) and got[2] == pytest.approx(0, abs=1e-6)


def test_paired_arms(spark):
    a = spark.createDataFrame([("g1", i, i % 3) for i in range(30)], "lottery string, ord long, hits long")
    same = significance.paired_compare(a, a, "hits").first()
    assert same.comparable and same.difference == 0
    other = significance.paired_compare(a, a.where("ord < 20"), "hits").first()
    assert not other.comparable and other.z is None


def test_probabilities_add_up(spark):
    d = prizes.grade_probabilities(spark, {"a": (33, 6, 6, 16, 1, 1), "b": (35, 5, 5, 12, 2, 2)})
    assert [round(r.s, 12) for r in d.groupBy("game").agg(F.sum("p").alias("s")).collect()] == [1, 1]
    assert sum(p for *_, p in prizes.special_probabilities()) == pytest.approx(1)
    assert sum(p for _, p in prizes.play_probabilities(10)) == pytest.approx(1)
    jackpot = {(r.game, r.h, r.j): r.p for r in d.collect()}
    assert 1 / jackpot["a", 6, 1] == pytest.approx(17_721_088) and 1 / jackpot["b", 5, 2] == pytest.approx(21_425_712)


@pytest.mark.parametrize("name,levels", [("2007-05", 8), ("2009-10", 8), ("2014-05", 6), ("2019-02", 9), ("2026-02", 7)])
def test_versions_have_thirteen_cells(name, levels):
    grades = {n: g for n, _, g, _, _ in prizes.DOUBLE_VERSIONS}[name]
    assert len(grades) == levels and sum(map(len, grades.values())) == 13


def test_version_bounds(spark):
    keys = [(2009, 120), (2009, 121), (2014, 51), (2014, 52), (2019, 18), (2019, 19), (2026, 13), (2026, 14), (2006, 1)]
    df = spark.createDataFrame([(i, y * 100_000 + s, 4, 0, 0) for i, (y, s) in enumerate(keys)], "k long, key long, h int, j int, pool_before long")
    got = [(r.version, r.grade) for r in prizes.grade_double(df).orderBy("k").collect()]
    assert got == [("2007-05", 6), ("2009-10", 6), ("2009-10", 6), ("2014-05", 5), ("2014-05", 5), ("2019-02", 7), ("2019-02", 7), ("2026-02", 5), (None, None)]


def test_quality_score(spark):
    df = spark.createDataFrame([(0, 3, 0.0, 0), (1, 4, 6.0, 3), (3, 3, 50.0, 99)], "f long, t long, z double, g long")
    got = [r.s for r in df.select(audit.quality_score(F.col("f"), F.col("t"), F.col("z"), F.col("g")).alias("s")).collect()]
    assert got == [100.0, 63.5, 0.0]
