"""How strategies stand: latest results by ledger, trend and baseline, and where prizes come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows whose means are compared for the trend, and the difference that counts.
TREND_ROWS = 10
TREND_STEP = 0.15
#: Grades are numbered from 1 to this.
GRADES = 10


def _grade_counts() -> Column:
    """The grades won, each with its count, as "grade:count" in order, joined by commas."""
    each = [F.struct(F.lit(g).alias("g"), F.count(F.when(F.col("grade") == g, 1)).alias("n")) for g in range(1, GRADES + 1)]
    won = F.filter(F.array(*each), lambda x: x["n"] > 0)
    return F.array_join(F.transform(won, lambda x: F.concat_ws(":", x["g"].cast("string"), x["n"].cast("string"))), ",")


def standings(settled: DataFrame, domain: str = "tier", lookback: int = 500, size: int = 33, choose: int = 6) -> DataFrame:
    """Per game, ledger (``domain``) and strategy over the ledger's latest ``lookback`` evaluated tickets.

    Columns: tickets, mean_main, mean_bonus, mean_total, wins, rate, grades
    ("grade:count", joined), edge (mean_main over that of a random ticket),
    trend and last (the latest draw day).  Every ledger of a game has its own
    ``lookback``, so a large one leaves the rows of a small one alone.  The
    trend compares the mean hits of the latest TREND_ROWS tickets with those of
    as many before: up, down or flat by TREND_STEP; none with fewer than
    TREND_ROWS tickets or none before.  Tickets of one day come by id, strategy
    and hits; the window over a ledger keeps ``lookback`` rows a partition
    before it shuffles.
    """
    order = [F.col("draw_date").desc(), "ticket_id", "strategy", "h", "j"]
    d = settled.where("status = 'evaluated'").select("lottery", F.col(domain).alias("domain"), "strategy", "ticket_id", "draw_date", "h", "j", "grade")
    d = d.withColumn("_at", F.row_number().over(Window.partitionBy("lottery", "domain").orderBy(*order))).where(F.col("_at") <= lookback)
    d = d.withColumn("_own", F.row_number().over(Window.partitionBy("lottery", "domain", "strategy").orderBy("_at"))).withColumn("_hits", F.col("h") + F.col("j"))
    new, old = F.col("_own") <= TREND_ROWS, (F.col("_own") > TREND_ROWS) & (F.col("_own") <= 2 * TREND_ROWS)
    mean = lambda c: F.round(F.avg(c), 6)
    g = d.groupBy("lottery", "domain", "strategy").agg(
        F.count(F.lit(1)).alias("tickets"), mean("h").alias("mean_main"), mean("j").alias("mean_bonus"), mean("_hits").alias("mean_total"), F.count("grade").alias("wins"), _grade_counts().alias("grades"),
        F.max("draw_date").alias("last"), F.round(F.avg(F.when(new, F.col("_hits"))) - F.avg(F.when(old, F.col("_hits"))), 9).alias("_step"),
    )
    trend = F.when((F.col("tickets") < TREND_ROWS) | F.col("_step").isNull(), "none").when(F.col("_step") > TREND_STEP, "up").when(F.col("_step") < -TREND_STEP, "down").otherwise("flat")
    edge = F.round(F.col("mean_main") - F.lit(choose * choose / size), 6)
    return g.select("lottery", "domain", "strategy", "tickets", "mean_main", "mean_bonus", "mean_total", "wins", F.round(F.col("wins") / F.col("tickets"), 6).alias("rate"), "grades", edge.alias("edge"), trend.alias("trend"), "last")


def prize_sources(settled: DataFrame, domain: str = "tier") -> DataFrame:
    """Evaluated tickets by game, ledger (``domain``) and strategy and all their totals (null stands for all).

    Columns: tickets, wins, rate, grades ("grade:count", joined), prizes (the
    known amounts) and unknown (wins whose amount is null, which add nothing).
    Null games, ledgers and strategies count as "-".
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(n) for c, n in (("lottery", "lottery"), (domain, "domain"), ("strategy", "strategy"))]
    d = settled.where("status = 'evaluated'").select(*keys, "grade", "amount")
    won = F.col("grade").isNotNull()
    g = d.cube("lottery", "domain", "strategy").agg(
        F.count(F.lit(1)).alias("tickets"), F.count("grade").alias("wins"), _grade_counts().alias("grades"), F.coalesce(F.sum(F.when(won, F.col("amount"))), F.lit(0)).cast("bigint").alias("prizes"),
        F.count(F.when(won & F.col("amount").isNull(), 1)).alias("unknown"),
    )
    return g.select("lottery", "domain", "strategy", "tickets", "wins", F.round(F.col("wins") / F.col("tickets"), 6).alias("rate"), "grades", "prizes", "unknown")
