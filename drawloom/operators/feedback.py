"""Comparisons, ledgers and budgets over settled tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import tax
from .order import rank_by_parts
from .settle import PRICE


#: What a main and a bonus hit count; the least weight of a strategy, and of how many tickets it is judged.
MAIN_HIT, BONUS_HIT = 0.6, 0.4
FLOOR, LEAST_TICKETS = 0.05, 10


def _evaluated(settled: DataFrame) -> DataFrame:
    return settled.where("status = 'evaluated'")


def _score():
    """0.6 a main hit and 0.4 a bonus hit."""
    return F.col("h") * MAIN_HIT + F.col("j") * BONUS_HIT


def tier_comparison(settled: DataFrame) -> DataFrame:
    """Per tier: tickets, draws, wins and their rate, mean score."""
    g = _evaluated(settled).groupBy("tier").agg(F.count(F.lit(1)).alias("tickets"), F.countDistinct("draw_k").alias("draws"), F.count("grade").alias("wins"), F.round(F.avg(_score()), 6).alias("score"))
    return g.withColumn("rate", F.round(F.col("wins") / F.col("tickets"), 6))


def strategy_weights(settled: DataFrame, floor: float = FLOOR, least: int = LEAST_TICKETS, gate: list[str] | None = None, mass: float = 0.5) -> DataFrame:
    """Weights that add up to 1, each at least ``floor`` (half of an equal share with more than ten strategies).

    A strategy counts by its mean score, one with under ``least`` tickets as an
    equal share, a negative mean by half and at least 1e-6.  With a ``gate`` (the
    strategies that have passed one) its strategies divide ``mass`` by their
    scores and the others the rest evenly; where none passed, all are equal.
    """
    g = _evaluated(settled).groupBy("strategy").agg(F.count(F.lit(1)).alias("tickets"), F.avg(_score()).alias("score"))
    everything = Window.partitionBy()  # one row a strategy
    n = F.count(F.lit(1)).over(everything)
    raw = F.when(F.col("tickets") < least, 1 / n).otherwise(F.greatest(F.when(F.col("score") < 0, F.col("score") * 0.5).otherwise(F.col("score")), F.lit(1e-6)))
    g = g.withColumn("raw", raw)
    if gate is not None:
        passed = F.col("strategy").isin(*gate) if gate else F.lit(False)
        winners = F.sum(passed.cast("int")).over(everything)
        won = mass * F.col("raw") / F.sum(F.when(passed, F.col("raw"))).over(everything)
        lost = F.try_divide(F.lit(1 - mass), n - winners)
        g = g.withColumn("raw", F.when(winners == 0, 1 / n).when(passed, won).otherwise(lost))
    lowest = F.when(n <= 10, F.lit(floor)).otherwise(0.5 / n)
    weight = lowest + (1 - n * lowest) * F.col("raw") / (F.sum("raw").over(everything) + 1e-8)
    return g.select("strategy", "tickets", F.round(weight, 6).alias("weight"))


def hit_trend(settled: DataFrame, n: int = 10, band: float = 0.15) -> DataFrame:
    """Mean total hits of each strategy's last ``n`` tickets against the up to ``n`` before: up, down or flat; none under ``n`` or without older ones.

    The latest draw comes first, then the greater id; of tickets with one id in one draw that with more hits.
    """
    hits = F.col("h") + F.col("j")
    w = Window.partitionBy("strategy").orderBy(F.col("draw_date").desc(), F.col("ticket_id").desc(), hits.desc())
    last = _evaluated(settled).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 2 * n)  # a top-n of each task before the shuffle
    g = last.groupBy("strategy").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(F.col("_rank") <= n, hits)).alias("_new"), F.avg(F.when(F.col("_rank") > n, hits)).alias("_old"))
    change = F.round(F.col("_new") - F.col("_old"), 6)
    return g.select("strategy", F.when((F.col("_n") < n) | F.col("_old").isNull(), "none").when(change > band, "up").when(change < -band, "down").otherwise("flat").alias("trend"), change.alias("change"))


def batch_ledger(settled: DataFrame) -> DataFrame:
    """Per draw: tickets, cost, gross, wins and wins of ten or more."""
    g = _evaluated(settled).groupBy(F.col("draw_k").alias("k")).agg(F.count(F.lit(1)).alias("tickets"), F.sum("amount").alias("gross"), F.count("grade").alias("wins"), F.count(F.when(F.col("amount") >= 10, 1)).alias("ten_or_more"))
    return g.withColumn("cost", F.col("tickets") * PRICE)


def filled_ledger(ledger: DataFrame, draws: DataFrame) -> DataFrame:
    """The ledger with a zero row for every draw that no ticket took part in."""
    counts = ["tickets", "gross", "wins", "ten_or_more", "cost"]
    return draws.select("lottery", "k").join(ledger, "k", "left").select("lottery", "k", F.col("tickets").isNotNull().alias("took_part"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def ledger_summary(filled: DataFrame) -> DataFrame:
    """Per game: draws and those taken part in, money after tax, share of taken draws with a win (null if none)."""
    paid = tax(F.col("gross").cast("double"))
    g = filled.groupBy("lottery").agg(
        F.count(F.lit(1)).alias("draws"), F.count(F.when(F.col("took_part"), 1)).alias("taken"), F.sum("cost").alias("cost"), F.sum("gross").alias("gross"), F.round(F.sum(paid), 4).alias("tax"), F.count(F.when(F.col("wins") > 0, 1)).alias("won")
    )
    return g.withColumn("net", F.round(F.col("gross") - F.col("tax") - F.col("cost"), 4)).withColumn("hit_share", F.round(F.try_divide("won", "taken"), 6))


def lift(settled: DataFrame, bins: int = 5) -> DataFrame:
    """Win rates by bins of the distinct scores, against the overall rate, with their standard errors and whether they rise throughout.

    Distinct scores are ranked by parts of the score range (``value`` widths), so
    no task orders all of them; bins are those of ntile.
    """
    rows = _evaluated(settled).groupBy("score").agg(F.count(F.lit(1)).alias("tickets"), F.count("grade").alias("wins")).where("score is not null").withColumn("one", F.lit(1))
    ends = rows.groupBy("one").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(F.broadcast(ends), "one")  # one row
    part = F.floor((F.col("score") - F.col("lo")) * 256 / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)))
    ranked = rank_by_parts(rows, ["one"], part, ["score"], "place")
    big, size = F.col("n") % bins, F.floor(F.col("n") / bins)
    place = F.col("place") - 1
    bin_ = F.when(place < big * (size + 1), F.floor(place / (size + 1))).otherwise(big + F.floor((place - big * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    g = ranked.groupBy(bin_.cast("bigint").alias("bin")).agg(F.sum("tickets").alias("tickets"), F.sum("wins").alias("wins"))
    everything = Window.partitionBy()  # one row a bin
    overall = F.sum("wins").over(everything) / F.sum("tickets").over(everything)
    rate = F.col("wins") / F.col("tickets")
    g = g.withColumn("_rise", rate >= F.lag(rate).over(Window.orderBy("bin")))
    return g.select("bin", "tickets", "wins", F.round(rate, 6).alias("rate"), F.round(rate / overall, 6).alias("lift"), F.round(F.sqrt(rate * (1 - rate) / F.col("tickets")), 6).alias("se"), F.coalesce(F.min("_rise").over(everything), F.lit(True)).alias("rising"))


def budget_groups(settled: DataFrame) -> DataFrame:
    """Money spent by month, by game, and by both, with the batches it was spent in."""
    rows = _evaluated(settled).select(F.date_trunc("month", "draw_date").cast("date").alias("month"), "lottery", "batch")
    sets = [["month"], ["lottery"], ["month", "lottery"]]
    return rows.groupingSets(sets, "month", "lottery").agg((F.count(F.lit(1)) * PRICE).alias("spent"), F.countDistinct("batch").alias("batches"))


def arm_overlap(tickets: DataFrame, a: str, b: str, universe: int) -> DataFrame:
    """Distinct combinations that two strategies share, against random choice from the universe."""
    combos = tickets.where(F.col("strategy").isin(a, b)).groupBy(F.array_join("main", "-").alias("main")).agg(F.max((F.col("strategy") == a).cast("int")).alias("a"), F.max((F.col("strategy") == b).cast("int")).alias("b"))
    g = combos.agg(F.sum("a").alias("in_a"), F.sum("b").alias("in_b"), F.sum(F.col("a") * F.col("b")).alias("both"))
    x, y = F.col("in_a").cast("double"), F.col("in_b").cast("double")
    mean = x * y / universe
    variance = mean * (1 - x / universe) * (universe - y) / (universe - 1)
    return g.select("in_a", "in_b", "both", F.round(mean, 6).alias("expected"), F.round((F.col("both") - mean) / F.sqrt(variance), 6).alias("z"))
