"""Conditions on hits, table functions, clusters that do not overlap, and corrections for many tests."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from drawloom.functions import table_functions
from drawloom.operators import draw_stats, hits, significance

SEVEN = hits.Game({"front": "f", "back": "b"}, choose={"front": 6, "back": 1})
DIGITS = hits.Game({f"place{i}": f"p{i}" for i in range(1, 4)}, {"outer": ["place1", "place3"]})


def test_conditions_are_parsed_or_refused():
    assert hits.parse_condition("") == hits.parse_condition(None) == hits.parse_condition(" , ") == {}
    assert hits.parse_condition("front:4, back:1,front:2") == {"front": 4, "back": 1} and hits.parse_condition("x:0") == {"x": 0}
    for bad in ("front", "front=3", ":3", "front:", "front:a", "front:-1", "front:1.5"):
        with pytest.raises(ValueError):
            hits.parse_condition(bad)
    assert hits.describe_condition({"front": 4, "back": 1}) == "front >= 4 and back >= 1" and hits.describe_condition({}) == "any"
    assert SEVEN.names() == ["total", "front", "back"] and DIGITS.names() == ["total", "place1", "place2", "place3", "outer"]
    assert SEVEN.choices() == [f"total:{n}" for n in range(1, 8)]
    with pytest.raises(ValueError):
        hits.Game({"a": "a"}, {"g": ["a", "b"]})


def test_conditions_on_rows(spark):
    d = spark.createDataFrame([(1, "s", 4, 1, None, None, None), (2, "s", 4, 0, None, None, None), (3, "d", None, None, 1, 0, 1), (4, "d", None, None, 1, 1, None)], "id int, lottery string, f int, b int, p1 int, p2 int, p3 int")
    games = {"s": SEVEN, "d": DIGITS}
    ids = lambda text, lottery=None: {r.id for r in d.where(hits.condition_of_games(games, text, lottery)).collect()}
    assert ids("front:4,back:1", "s") == {1} and ids("", "s") == {1, 2} and ids("outer:2", "d") == {3} and ids("place2:1,total:2", "d") == {4} and ids("total:2") == {1, 2, 3, 4} and ids("total:5") == {1}
    for text, lottery in (("front:1", "d"), ("front:1", None), ("total:1", "x"), ("outer:1", "s")):
        with pytest.raises(ValueError):
            hits.condition_of_games(games, text, lottery)


def test_table_functions(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, [1, 2, 5]), (2, [7, 8]), (3, None)], "id int, m array<long>").createOrReplaceTempView("held")
    got = {(r.id, tuple(r.subset)) for r in spark.sql("SELECT id, subset FROM held, LATERAL t_subsets(m, 2)").collect()}
    assert got == {(1, (1, 2)), (1, (1, 5)), (1, (2, 5)), (2, (7, 8))}
    for n, k in ((6, 3), (5, 1), (4, 4)):
        assert sorted(tuple(r.numbers) for r in spark.sql(f"SELECT * FROM combinations({n}, {k})").collect()) == list(combinations(range(1, n + 1), k))


def test_clusters_do_not_overlap(spark):
    import random

    rng = random.Random(4)
    rows = [("a", o, rng.randint(4, 9), False) for o in sorted(rng.sample(range(15, 6000), 900))] + [("a", o, 5, True) for o in range(6100, 6400)] + [("b", 20, 4, False)]
    got = significance.best_clusters(spark.createDataFrame(rows, "lottery string, ord bigint, n bigint, severe boolean"), 15, 10).collect()
    taken = []
    for _, o, n, _ in sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[2], r[1])):
        if len(taken) < 10 and all(abs(o - t) >= 15 for t, _ in taken):
            taken.append((o, n))
    assert [(r.ord, r.n) for r in sorted((r for r in got if r.lottery == "a"), key=lambda r: r.place)] == taken
    assert [(r.ord, r.place) for r in got if r.lottery == "b"] == [(20, 1)]
    everything = significance.best_clusters(spark.createDataFrame(rows, "lottery string, ord bigint, n bigint, severe boolean"), 15, 10_000).where("lottery = 'a' and ord >= 6100").orderBy("ord").collect()
    assert [r.ord for r in everything] == list(range(6100, 6400, 15))


def test_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r.k: r for r in draw_stats.adjusted(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "k int, p double").withColumn("f", F.lit(1)), "p", ["f"], ["k"]).collect()}
    assert [round(got[i].p_adjusted, 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]
    assert [round(got[i].bonferroni, 6) for i in range(4)] == [0.04, 0.16, 0.12, 1.0] and got[0].sidak == pytest.approx(1 - 0.99**4)
