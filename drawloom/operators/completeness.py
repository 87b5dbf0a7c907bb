"""Back-filling, comparing and validating draws, tickets and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import KEY


def backfill_sales(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local draws whose missing or zero sales are taken from ``web`` where the drawn numbers agree.

    ``state`` says what happened: kept, filled, mismatched, not_found or empty
    (the other side has none either).
    """
    other = web.select(*KEY, F.array_sort("front").alias("_front"), F.col("sales").alias("_sales"))
    both = local.join(other, KEY, "left")
    state = (
        F.when(F.coalesce("sales", F.lit(0)) != 0, "kept")
        .when(F.col("_front").isNull(), "not_found")
        .when(F.array_sort("front") != F.col("_front"), "mismatched")
        .when(F.col("_sales") > 0, "filled")
        .otherwise("empty")
    )
    both = both.withColumn("state", state)
    return both.select(*KEY, F.when(F.col("state") == "filled", F.col("_sales")).otherwise(F.col("sales")).alias("sales"), "state")


def one_sided_issues(history: DataFrame, sales: DataFrame) -> DataFrame:
    """Issues that only one of two tables has, and which."""
    a = history.select(*KEY, F.lit(1).alias("_a")).distinct()
    b = sales.select(*KEY, F.lit(1).alias("_b")).distinct()
    both = a.join(b, KEY, "full_outer").where("_a is null or _b is null")
    return both.select(*KEY, F.when(F.col("_b").isNull(), "history").otherwise("sales").alias("only_in"))


def verify_latest(local: DataFrame, remote: DataFrame, n: int) -> DataFrame:
    """Per game, how many of the last ``n`` local draws the remote side has equal, different or not at all."""
    w = Window.partitionBy("lottery").orderBy(F.col("issue_year").desc(), F.col("issue_seq").desc())
    last = local.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    other = remote.select(*KEY, F.array_sort("front").alias("_front"))
    both = last.join(other, KEY, "left").withColumn("_same", F.array_sort("front") == F.col("_front"))
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy("lottery").agg(count(F.col("_same")).alias("equal"), count(~F.col("_same")).alias("different"), count(F.col("_front").isNull()).alias("missing"))


def calendar_missing(draws: DataFrame, weekdays: list[int]) -> DataFrame:
    """Expected draw days (Monday is 0) between a game's first and last day that have no draw."""
    span = draws.groupBy("lottery").agg(F.min("draw_date").alias("lo"), F.max("draw_date").alias("hi"))
    days = span.select("lottery", F.explode(F.sequence("lo", "hi")).alias("day")).where(F.weekday("day").isin(*weekdays))
    return days.join(draws.select("lottery", F.col("draw_date").alias("day")).distinct(), ["lottery", "day"], "left_anti")


def calendar_open(draws: DataFrame, weekdays: list[int], closures: DataFrame) -> DataFrame:
    """``calendar_missing`` without the days in closures (first, last), a small table of spans."""
    days = F.broadcast(closures.select(F.explode(F.sequence("first", "last")).alias("day")).distinct())
    return calendar_missing(draws, weekdays).join(days, "day", "left_anti").select("lottery", "day")


def calendar_lag(draws: DataFrame, weekdays: list[int]) -> DataFrame:
    """(lottery, latest, expected, lag): each game's latest draw day, the last expected day up to the latest of all games, and the days between."""
    latest = draws.groupBy("lottery").agg(F.max("draw_date").alias("latest"))
    end = latest.agg(F.max("latest").alias("end"))  # one row
    days = end.select(F.explode(F.sequence(F.date_sub("end", 6), "end")).alias("day")).where(F.weekday("day").isin(*weekdays)).agg(F.max("day").alias("expected"))
    return latest.crossJoin(F.broadcast(days)).select("lottery", "latest", "expected", F.greatest(F.lit(0), F.datediff("expected", "latest")).cast("bigint").alias("lag"))


def number_errors(numbers: Column, size: int, low: int, high: int, repeatable: bool = False) -> Column:
    """What is wrong with the numbers of a zone: count, range and repeat, as an array."""
    found = [
        F.when(F.size(numbers) != size, "count"),
        F.when(F.exists(numbers, lambda x: (x < low) | (x > high)), "range"),
    ]
    if not repeatable:
        found.append(F.when(F.size(F.array_distinct(numbers)) < F.size(numbers), "repeat"))
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def binomial(n: Column, k: Column) -> Column:
    """C(n, k) as a long; 0 where k is negative or above n."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    value = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: F.floor((acc * (n - k + i)) / i).cast("bigint"))
    return F.when((k < 0) | (k > n), F.lit(0)).when(k == 0, F.lit(1)).otherwise(value).cast("bigint")


def ticket_bets(pool: Column, bankers: Column, choose: int, bonus_pool: Column) -> Column:
    """Bets that a multiple ticket stands for: bankers are in every bet; none if all places are bankers."""
    need = F.lit(choose) - bankers
    return F.when(need > 0, binomial(pool - bankers, need) * bonus_pool).otherwise(F.lit(0)).cast("bigint")


def unique_feedback(settled: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(order)
    return settled.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def rule_version(key: Column, starts: list[tuple[int, int]]) -> Column:
    """Number from 1 of the last version that starts at or before the issue key (year * 100000 + seq); null before the first."""
    begun = F.filter(F.array(*(F.lit(y * 100_000 + s) for y, s in starts)), lambda x: x <= key)
    return F.when(F.size(begun) > 0, F.size(begun)).cast("bigint")
