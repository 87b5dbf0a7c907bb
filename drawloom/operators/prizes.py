"""Prize tables of the games by rule version, grading, probabilities and actual amounts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import digit_shape, norm_level_name
from .merge import PRIORITY

#: The 5-of-35 and 2-of-12 game's grades by (main hits, bonus hits), version by version:
#: name, first issue (year, seq), {grade: cells}, {grade: fixed amount} (grades without one float), {grade: amount while the pool is high}.
DOUBLE_VERSIONS = (
    ("2007-05", (2007, 1), {1: ((5, 2),), 2: ((5, 1),), 3: ((5, 0),), 4: ((4, 2),), 5: ((4, 1),), 6: ((3, 2), (4, 0)), 7: ((3, 1), (2, 2)), 8: ((3, 0), (2, 1), (1, 2), (0, 2))}, {4: 3000, 5: 500, 6: 200, 7: 10, 8: 5}, {}),
    ("2009-10", (2009, 121), {1: ((5, 2),), 2: ((5, 1),), 3: ((5, 0),), 4: ((4, 2),), 5: ((4, 1),), 6: ((3, 2), (4, 0)), 7: ((3, 1), (2, 2)), 8: ((3, 0), (2, 1), (1, 2), (0, 2))}, {4: 3000, 5: 600, 6: 100, 7: 10, 8: 5}, {}),
    ("2014-05", (2014, 52), {1: ((5, 2),), 2: ((5, 1),), 3: ((5, 0), (4, 2)), 4: ((4, 1), (3, 2)), 5: ((4, 0), (3, 1), (2, 2)), 6: ((3, 0), (2, 1), (1, 2), (0, 2))}, {4: 200, 5: 10, 6: 5}, {}),
    ("2019-02", (2019, 19), {1: ((5, 2),), 2: ((5, 1),), 3: ((5, 0),), 4: ((4, 2),), 5: ((4, 1),), 6: ((3, 2),), 7: ((4, 0),), 8: ((3, 1), (2, 2)), 9: ((3, 0), (2, 1), (1, 2), (0, 2))}, {3: 10000, 4: 3000, 5: 300, 6: 200, 7: 100, 8: 15, 9: 5}, {}),
    ("2026-02", (2026, 14), {1: ((5, 2),), 2: ((5, 1),), 3: ((5, 0), (4, 2)), 4: ((4, 1),), 5: ((4, 0), (3, 2)), 6: ((3, 1), (2, 2)), 7: ((3, 0), (2, 1), (1, 2), (0, 2))}, {3: 5000, 4: 300, 5: 150, 6: 15, 7: 5}, {3: 6666, 4: 380, 5: 200, 6: 18, 7: 7}),
)
#: The pool from which on the higher amounts are paid.
HIGH_POOL = 800_000_000
#: The prizes of three digits in order, in a pair, and all different.
DIGIT_PRIZES = {"direct": 1040, "group3": 346, "group6": 173}
#: Grades of six digits and a seventh by (hits of six, hit of the seventh), and their amounts (0: floating).
SEVEN_GRADES = {1: 0, 2: 0, 3: 3000, 4: 500, 5: 30, 6: 5}


def double_rules(spark: SparkSession) -> DataFrame:
    """(version, from_key, to_key, h, j, grade, amount, high_amount): keys are year * 100000 + seq; a floating amount is null."""
    rows = []
    for i, (name, (y, s), grades, fixed, high) in enumerate(DOUBLE_VERSIONS):
        to = DOUBLE_VERSIONS[i + 1][1] if i + 1 < len(DOUBLE_VERSIONS) else (9999, 0)
        for grade, cells in grades.items():
            rows += [(name, y * 100_000 + s, to[0] * 100_000 + to[1], h, j, grade, fixed.get(grade), high.get(grade)) for h, j in cells]
    return spark.createDataFrame(rows, "version string, from_key long, to_key long, h int, j int, grade int, amount long, high_amount long")


def grade_double(hits: DataFrame) -> DataFrame:
    """(…, key, h, j, pool_before) with version, grade (null: nothing won) and amount (null: floating); keys before the first version have no version."""
    table = double_rules(hits.sparkSession)
    versions = F.broadcast(table.select("version", "from_key", "to_key").distinct())  # one row a version
    d = hits.join(versions, (F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("to_key")), "left").drop("from_key", "to_key")
    d = d.join(F.broadcast(table.drop("from_key", "to_key")), ["version", "h", "j"], "left")  # a row a cell
    amount = F.when((F.col("pool_before") >= HIGH_POOL) & F.col("high_amount").isNotNull(), F.col("high_amount")).otherwise(F.col("amount"))
    return d.withColumn("amount", amount).drop("high_amount")


def grade_digits(ticket: Column, draw: Column) -> Column:
    """direct, group3, group6 or null for three digits."""
    same = F.array_sort(ticket) == F.array_sort(draw)
    return F.when(F.size(ticket) != 3, None).when(ticket == draw, "direct").when(same & (digit_shape(ticket) == "pair"), "group3").when(same, "group6")


def grade_seven(six_hits: Column, last_hit: Column) -> Column:
    """Grade 1 to 6 of six digits and a seventh, or null."""
    total = six_hits + last_hit
    return F.when(total == 7, 1).when((six_hits == 6) & (last_hit == 0), 2).when((six_hits == 5) & (last_hit == 1), 3).when(total == 5, 4).when(total == 4, 5).when((total >= 3) | (last_hit == 1), 6)


def grade_thirty(basic_hits: Column, special_hit: Column) -> Column:
    """Grade 1 to 7 of 7 of 30 numbers with a special one, or null."""
    return (
        F.when(basic_hits == 7, 1).when((basic_hits == 6) & (special_hit == 1), 2).when(basic_hits == 6, 3).when((basic_hits == 5) & (special_hit == 1), 4).when(basic_hits == 5, 5).when((basic_hits == 4) & (special_hit == 1), 6).when(basic_hits == 4, 7)
    )


def grade_eighty(width: Column, hits: Column) -> Column:
    """Name of the play and hits of the 80-number game, such as 选十中九; whether it pays is the table's matter."""
    names = F.array(*map(F.lit, "零一二三四五六七八九十"))
    return F.when(width.between(1, 10) & hits.between(0, width), F.concat(F.lit("选"), F.get(names, width.cast("int")), F.lit("中"), F.get(names, hits.cast("int"))))


def grade_probabilities(spark: SparkSession, games: dict[str, tuple[int, int, int, int, int, int]]) -> DataFrame:
    """(game, h, j, p): exact chances of h main and j bonus hits for games (main size, drawn, chosen, bonus size, drawn, chosen)."""
    hyper = lambda n, d, c, h: math.comb(d, h) * math.comb(n - d, c - h) / math.comb(n, c) if 0 <= c - h <= n - d else 0.0
    rows = [(g, h, j, hyper(n, d, c, h) * hyper(m, e, b, j)) for g, (n, d, c, m, e, b) in games.items() for h in range(min(d, c) + 1) for j in range(min(e, b) + 1)]
    return spark.createDataFrame([r for r in rows if r[3] > 0], "game string, h int, j int, p double")


def special_probabilities(n: int = 30, k: int = 7) -> list[tuple[int, int, float]]:
    """(h, j, p) of k of n numbers with one special number out of the rest."""
    return [(h, j, math.comb(k, h) * math.comb(1, j) * math.comb(n - k - 1, k - h - j) / math.comb(n, k)) for h in range(k + 1) for j in (0, 1) if 0 <= k - h - j <= n - k - 1]


def play_probabilities(width: int, n: int = 80, drawn: int = 20) -> list[tuple[int, float]]:
    """(hits, p) of a play of the 80-number game."""
    return [(k, math.comb(drawn, k) * math.comb(n - drawn, width - k) / math.comb(n, width)) for k in range(width + 1)]


def nominal_ev(chances: DataFrame, table: DataFrame, price: float) -> DataFrame:
    """(version, any, ev): chance of any prize and mean return less ``price`` by version, floating amounts as ``assumed``."""
    d = chances.join(F.broadcast(table), ["h", "j"])
    return d.groupBy("version").agg(F.round(F.sum("p"), 9).alias("any"), F.round(F.sum(F.col("p") * F.coalesce("amount", "assumed")) - price, 6).alias("ev"))


def actual_amounts(wanted: DataFrame, prizes: DataFrame) -> DataFrame:
    """(…, amount, note) for the wanted (lottery, k, grade, rule_amount) from prize rows (lottery, k, source, level, level_name, amount).

    Of a draw's sources only the best counts that has the grade; add-on levels
    (101 and up) do not.  Base and award rows are added; an award alone comes on
    top of the rule's amount; without rows the rule's amount stands.
    """
    name = norm_level_name(F.col("level_name"))
    rows = prizes.where((F.col("amount") > 0) & (F.col("level") < 101)).withColumn("n", name).where(~F.col("n.is_addon"))
    rows = rows.select("lottery", "k", "source", "level", "level_name", "amount", F.col("n.grade").alias("grade"), F.col("n.is_award").alias("award")).distinct()
    part = lambda c, n: F.sum(F.when(c, F.col("amount"))).alias(n)
    per = rows.groupBy("lottery", "k", "grade", "source").agg(part(~F.col("award"), "base"), part(F.col("award"), "extra"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")), F.lit(99))
    best = per.groupBy("lottery", "k", "grade").agg(F.min_by(F.struct("base", "extra"), F.struct(rank, "source")).alias("b"))
    d = wanted.join(best, ["lottery", "k", "grade"], "left")
    base, extra, rule = F.col("b.base"), F.col("b.extra"), F.col("rule_amount")
    amount = F.when(base.isNotNull(), base + F.coalesce(extra, F.lit(0))).when(extra.isNotNull(), rule + extra).otherwise(rule)
    note = F.when(extra.isNotNull() & (base.isNotNull() | rule.isNotNull()), "measured+award").when(base.isNotNull(), "measured").otherwise("rule")
    return d.select(*wanted.columns, amount.alias("amount"), note.alias("note"))


def settle_by_date(tickets: DataFrame, draws: DataFrame) -> DataFrame:
    """(ticket_id, k, matched): the draw a ticket names, else its game's draw of exactly its target day (of several the last), else none; never the latest."""
    named = draws.select("lottery", F.col("k").alias("draw_k"), F.lit(True).alias("_named"))
    by_day = draws.groupBy("lottery", F.col("draw_date").alias("target_date")).agg(F.max_by("k", F.struct("issue_year", "issue_seq")).alias("_day_k"))
    d = tickets.join(named, ["lottery", "draw_k"], "left").join(by_day, ["lottery", "target_date"], "left")
    k = F.when(F.col("_named"), F.col("draw_k")).otherwise(F.col("_day_k"))
    return d.select("ticket_id", k.alias("k"), F.when(F.col("_named"), "issue").when(k.isNotNull(), "date").otherwise("none").alias("matched"))


def rollover(draws: DataFrame, p1: float, share: float, cap: float, fixed: float, price: float = 2.0) -> DataFrame:
    """Per draw (with ``pool``): expected first winners, estimated first prize, expected value of a ticket, how thick the pool is, and whether the prize is at its cap."""
    lam = F.coalesce(F.col("sales"), F.lit(0)) / price * p1
    head = F.coalesce(F.col("pool"), F.lit(0)) * share
    each = F.when(head > 0, F.least(F.lit(cap), head / F.greatest(lam, F.lit(1e-9)))).otherwise(0.0)
    margin = F.when(head > 0, head / cap / F.greatest(lam, F.lit(1e-9))).otherwise(0.0)
    return draws.select("lottery", "issue_year", "issue_seq", F.round(lam, 6).alias("winners"), F.round(each, 2).alias("prize"), F.round(-price + p1 * each + fixed, 6).alias("ev"), F.round(margin, 6).alias("margin"), ((each >= cap * 0.999) & (lam > 0)).alias("at_cap"))


def pool_threshold(p1: float, share: float, cap: float, theta: float, mu: Column) -> Column:
    """The pool from which on the first prize reaches ``theta`` of its cap with ``mu`` winners to share."""
    return theta * cap * mu / share


def period_ev(draws: DataFrame, n: int, p1: float, p2: float, fixed: float, price: float = 2.0) -> DataFrame:
    """Per game over its last ``n`` draws: expected value of a ticket from the prizes paid (``prize1``, ``prize2``) and the fixed part: mean, most, least, share of positive draws."""
    w = Window.partitionBy("lottery").orderBy(F.col("issue_year").desc(), F.col("issue_seq").desc())
    last = draws.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n)  # a top-n of each task before the shuffle
    ev = F.col("prize1") * p1 + F.col("prize2") * p2 + fixed - price
    return last.groupBy("lottery").agg(F.count(F.lit(1)).alias("draws"), F.round(F.avg(ev), 6).alias("mean"), F.round(F.max(ev), 6).alias("most"), F.round(F.min(ev), 6).alias("least"), F.round(F.avg((ev > 0).cast("int")), 6).alias("positive"))
