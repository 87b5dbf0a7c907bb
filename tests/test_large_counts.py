"""Statistics of histories so long that products of their counts fit in no 64-bit number."""

from pyspark.sql import functions as F

from drawloom.operators import significance as sg


def test_goodness_of_fit_beyond_64_bits(spark):
    rows = [("g1", "a", 6_000_000_000, 3_000_000_000_000), ("g1", "b", 4_000_000_000, 3_000_000_000_000)]
    got = sg.goodness_of_fit(spark.createDataFrame(rows, "lottery string, region string, w bigint, s bigint"), "w", "s", ["lottery"]).collect()
    assert [(r.chi2, r.df) for r in got] == [(4e8, 1)]


def test_runs_of_millions_of_draws(spark, monkeypatch):
    from drawloom.operators import draw_stats as st

    n = 2_200_000  # n ** 3 is over 2 ** 63
    d = spark.range(1, n + 1).select(F.lit("g1").alias("lottery"), F.col("id").alias("ord"), (F.col("id") % 2).alias("sales"))
    monkeypatch.setattr(st, "with_order", lambda draws: draws)
    (r,) = st.runs_test(d).collect()
    assert (r.runs, r.n1, r.n2) == (n, n // 2, n // 2)
    assert r.z == round((n - (n / 2 + 1)) / ((n / 2) * (n / 2 - 1) / (n - 1)) ** 0.5, 6)
