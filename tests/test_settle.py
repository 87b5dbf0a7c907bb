"""Settling: tickets without a draw, and what it takes to bring tickets and draws together."""

import re

from pyspark.sql import functions as F

from drawloom.operators import audit, settle
from drawloom.plans import catalogue


def _tables(spark, n):
    tickets = spark.range(n).select(
        F.col("id").alias("ticket_id"), F.col("id").alias("batch"), F.expr("case when id % 3 = 0 then cast(null as bigint) when id % 7 = 0 then -id else id div 2 end").alias("draw_k"), F.expr("array(1L, 2L, 3L, 4L, 5L, 6L)").alias("main"),
        F.expr("array(1L)").alias("bonus"), F.lit("A").alias("strategy"), F.lit("O").alias("tier"), F.lit(0.1).alias("score"), F.expr("timestamp'2020-01-01'").alias("generated"),
    )
    draws = spark.range(1, n).select(F.col("id").alias("k"), F.lit("g1").alias("lottery"), F.expr("date'2020-01-02'").alias("draw_date"), F.expr("array(1L, 2L, 3L, 7L, 8L, 9L)").alias("front"), F.expr("array(1L)").alias("back"))
    return tickets, draws


def test_tickets_without_a_draw_are_spread(spark):
    n = 4000
    tickets, draws = _tables(spark, n)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(before, ("-1", "false", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        made = settle.settle(tickets, draws)
        got = {r.ticket_id: r for r in made.collect()}
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == n and max(sizes) < 2 * n / 8
    for i, r in got.items():
        k = None if i % 3 == 0 else -i if i % 7 == 0 else i // 2
        there = k is not None and k > 0
        assert (r.draw_k, r.status, r.h, r.j, r.grade, r.amount, r.lottery) == ((k, "evaluated", 3, 1, 5, 10, "g1") if there else (k, "pending", None, None, None, None, None))


def test_health_meets_draws_once(spark):
    tickets, draws = _tables(spark, 40)
    made = audit.feedback_health(settle.settle(tickets, draws.withColumn("issue_year", F.lit(1999)), keep=("generated", "issue_year")).where("status = 'evaluated'").withColumn("version", F.col("issue_year")), None, 0.05)
    n = sum(i % 3 != 0 and i % 7 != 0 and i > 1 for i in range(40))
    assert [tuple(r) for r in made.collect()] == [("g1", n, 0, 0.0, 1, False)]
    assert [tuple(r) for r in audit.feedback_health(settle.settle(tickets, draws, keep=("generated",)).drop("lottery", "draw_date").withColumn("version", F.lit(1)), draws, 0.05).collect()] == [("g1", n, 0, 0.0, 1, False)]
    plan = catalogue.QUERIES["v6_health"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join \w+, .*draw_k", plan)) == 1
