"""Rules that show only in long histories: issue numbers of six digits, tickets that share an id, expressions that must be worked out once a row."""

from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from drawloom.functions import scalar
from drawloom.operators import feedback as fb
from drawloom.operators import significance as sg
from drawloom.plans import bridge as br
from drawloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_issue_texts_keep_six_digits(spark, monkeypatch):
    one = spark.sql("SELECT 'g1' AS lottery, 1996L AS issue_year, 1L AS k, 123456L AS issue_seq, DATE '1996-05-01' AS draw_date, 5L AS sales, 1L AS first_winners, array(1L) AS front, array(1L) AS back")
    monkeypatch.setattr(br, "draws", lambda s, d: one)
    got = br.sources(spark, "").select("source", scalar.issue_key(F.col("issue")).alias("key")).collect()
    assert sorted((r.source, r.key.year, r.key.seq) for r in got) == [("agg", 1996, 123456), ("csv", 1996, 123456), ("official", 1996, 123456)]


def test_sql_of_append_knows_years_of_more_than_99999_draws():
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i * 4 AS o_orderkey, 1 AS o_custkey, 1.0 AS o_totalprice, CASE WHEN i <= 100010 THEN TIMESTAMP '1996-05-01' ELSE TIMESTAMP '1997-05-01' END AS o_orderdate FROM range(1, 100016) t(i)")
    assert sorted(con.execute(catalogue.ORACLES["m4_append"]).fetchall()) == [("g1", 1997, i) for i in range(1, 6)]


@pytest.mark.parametrize("turned", [False, True])
def test_trend_of_tickets_that_share_an_id(spark, turned):
    rows = [("A", "evaluated", date(2020, 1, 1), 100 - min(i, 9), 0 if i < 9 else 6 * (i == 10), 0) for i in range(20)]
    settled = spark.createDataFrame(rows[::-1] if turned else rows, "strategy string, status string, draw_date date, ticket_id bigint, h int, j int").coalesce(1)
    (r,) = fb.hit_trend(settled).collect()
    assert (r.trend, r.change) == ("up", 0.6)  # the only ticket with hits is the tenth: of its id it has the most


@pytest.mark.parametrize("name", ["t12_sliding", "t14_zones"])
def test_counts_of_a_window_are_worked_out_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(counts") <= 3


def test_starts_of_replicates_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(sg, "PIECE", 2)
    n, block = 23, 4
    d = spark.range(1, n + 1).select(F.lit("g1").alias("lottery"), F.lit(2000).cast("bigint").alias("issue_year"), F.col("id").alias("issue_seq"), (F.col("id") * F.col("id")).alias("x"))
    made = sg.block_bootstrap(d, ["x"], block, 3, 11)
    want = []
    for r in (1, 2, 3):
        total = 0
        for j in range(-(-n // block)):
            x = (r * 7919 + j * 104729 + 11 * 1299709) % 2147483647
            for _ in range(3):
                x = x * 48271 % 2147483647
            total += sum(((x % n + i) % n + 1) ** 2 for i in range(block))
        want.append((r, total))
    assert sorted((r.replicate, r.x) for r in made.collect()) == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [" in plan and "strategy=merge" in plan  # estimated by the few rows they are made from
