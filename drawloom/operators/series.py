"""Runs, segments, folds and further tests on series of draws, and strategies walked forward over them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draw_stats import arrays, omissions, omitted, past_counts, windowed, with_last_seen
from .order import PART, by, by_stretches, medians, rank_by_parts, stretched, with_order


def _totals(d: DataFrame) -> DataFrame:
    """``d`` with the number ``n`` of its game's draws."""
    return d.join(F.broadcast(d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))), "lottery")  # one row a game


def summary_stats(freq: DataFrame, omitted: DataFrame, per_draw: int) -> DataFrame:
    """Per game: numbers, the rate each should have, mean and population deviation of their frequencies, the five hottest and coldest, largest omission."""
    place = lambda order: F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("t"), F.col("num").alias("num")))), 1, 5), lambda x: x["num"])
    g = freq.groupBy("lottery").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.lit(per_draw) / F.count(F.lit(1)), 6).alias("rate"), F.round(F.avg("times"), 6).alias("mean"), F.round(F.stddev_pop("times"), 6).alias("deviation"),
        F.array_join(place(-F.col("times")), "-").alias("hot"), F.array_join(place(F.col("times")), "-").alias("cold"),
    )
    return g.join(omitted.groupBy("lottery").agg(F.max("omitted").alias("max_omission")), "lottery")


def volatility(freq: DataFrame, per_draw: int) -> DataFrame:
    """Observed deviation of the frequencies against the one of equal shares, and its excess in percent."""
    g = freq.groupBy("lottery").agg(F.count(F.lit(1)).alias("size"), (F.sum("times") / per_draw).alias("draws"), F.stddev_pop("times").alias("seen"))
    share = F.lit(float(per_draw)) / F.col("size")
    expected = F.sqrt(F.col("draws") * share * (1 - share))
    return g.select("lottery", F.round("seen", 6).alias("seen"), F.round(expected, 6).alias("expected"), F.round((F.col("seen") / expected - 1) * 100, 4).alias("excess"))


def _spells(d: DataFrame, value: Column) -> DataFrame:
    """(lottery, value, first, length) of the longest stretches of draws with one value, in (lottery, ord, ...).

    A draw whose value differs from the one before starts a spell; a spell ends
    where the next one starts, so only the starts are ordered.
    """
    d = stretched(d.select("lottery", "ord", value.alias("value")), 1)
    starts = d.withColumn("_before", F.lag("value").over(by())).where(~F.col("lead") & ~F.col("value").eqNullSafe(F.col("_before")) | (F.col("ord") == 1))
    starts = starts.where("not lead").select("lottery", F.col("ord").alias("first"), "value")
    ranked = with_rank(starts)
    following = ranked.select("lottery", (F.col("place") - 1).alias("place"), F.col("first").alias("next"))
    ends = d.where("not lead").groupBy("lottery").agg(F.max("ord").alias("n"))
    return ranked.join(following, ["lottery", "place"], "left").join(F.broadcast(ends), "lottery").select("lottery", "value", "first", (F.coalesce("next", F.col("n") + 1) - F.col("first")).alias("length"))  # one row a game


def with_rank(starts: DataFrame) -> DataFrame:
    return rank_by_parts(starts, ["lottery"], F.expr(f"first div {PART}"), ["first"], "place")


def dry_runs(draws: DataFrame) -> DataFrame:
    """Per game: spells of draws without a first prize, their number and the longest."""
    spells = _spells(with_order(draws), F.col("first_winners") == 0).where("value")
    return spells.groupBy("lottery").agg(F.count(F.lit(1)).alias("spells"), F.max("length").alias("longest"))


def same_value_runs(draws: DataFrame) -> DataFrame:
    """Per game: the longest run of draws with the same bonus number, which number and from which draw on; of equals the first."""
    spells = _spells(with_order(draws), F.element_at("back", 1))
    best = F.min(F.struct((-F.col("length")).alias("l"), "first", "value"))
    return spells.groupBy("lottery").agg(best.alias("b")).select("lottery", (-F.col("b.l")).alias("longest"), "b.first", F.col("b.value").alias("number"))


def segments(draws: DataFrame, k: int) -> DataFrame:
    """Median sales of ``k`` equal stretches of a game's draws, and whether the last is over 20 % off the first."""
    d = _totals(with_order(draws)).withColumn("segment", F.expr(f"(ord - 1) * {k} div n"))
    g = d.groupBy("lottery", "segment").agg(F.count(F.lit(1)).alias("draws")).join(medians(d, ["lottery", "segment"], "sales"), ["lottery", "segment"])
    ends = g.groupBy("lottery").agg(F.min_by("middle", "segment").alias("_a"), F.max_by("middle", "segment").alias("_b"))
    return g.join(F.broadcast(ends), "lottery").select("lottery", "segment", "draws", F.round("middle", 4).alias("middle"), (F.abs(F.col("_b") / F.col("_a") - 1) > 0.2).alias("shifted"))  # one row a game


def walk_forward_folds(draws: DataFrame, splits: int, min_train: int) -> DataFrame:
    """Validation blocks after the first ``min_train`` draws; a block trains on all strictly older draws."""
    d = _totals(with_order(draws)).where(F.col("ord") > min_train)
    d = d.withColumn("fold", F.expr(f"(ord - 1 - {min_train}) * {splits} div (n - {min_train})"))
    return d.groupBy("lottery", "fold").agg(F.count(F.lit(1)).alias("validate"), (F.min("ord") - 1).cast("bigint").alias("train"))


def serial_pairs(draws: DataFrame, size: int) -> DataFrame:
    """Chi-square of the ordered pairs of successive bonus numbers against equal shares."""
    d = stretched(with_order(draws).select("lottery", "ord", F.element_at("back", 1).alias("x")), 1)
    pairs = d.withColumn("y", F.lag("x").over(by())).where("y is not null and not lead").groupBy("lottery", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    g = pairs.groupBy("lottery").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq"))
    return g.select("lottery", "n", F.round(F.col("sq") * (size * size) / F.col("n") - F.col("n"), 6).alias("chi2"), F.lit(size * size - 1).cast("bigint").alias("df"))


def block_frequency(draws: DataFrame, size: int, block: int) -> DataFrame:
    """Chi-squares of the bonus numbers of full blocks of draws, added up; in excess if over 1.5 times what to expect."""
    d = with_order(draws).select("lottery", F.expr(f"(ord - 1) div {block}").alias("block"), F.element_at("back", 1).alias("x"))
    cells = d.groupBy("lottery", "block", "x").agg(F.count(F.lit(1)).alias("c"))
    blocks = cells.groupBy("lottery", "block").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(F.col("n") == block)
    g = blocks.groupBy("lottery").agg(F.count(F.lit(1)).alias("blocks"), F.sum("sq").alias("sq"))
    chi, df = F.col("sq") * size / block - F.col("blocks") * block, F.col("blocks") * (size - 1)
    return g.select("lottery", "blocks", F.round(chi, 6).alias("chi2"), df.alias("df"), (chi / df > 1.5).alias("excess"))


def benford(draws: DataFrame, value: str) -> DataFrame:
    """Chi-square of first digits against log10(1 + 1/d)."""
    digits = draws.where(F.col(value) > 0).groupBy("lottery", F.substring(F.col(value).cast("string"), 1, 1).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("lottery"))  # nine rows a game
    parts = digits.withColumn("n", total).withColumn("part", F.col("c") * F.col("c") / (F.col("n") * F.log10(1 + 1 / F.col("d"))))
    return parts.groupBy("lottery").agg(F.max("n").alias("n"), F.round(F.sum("part") - F.max("n"), 6).alias("chi2"))


def recent_shift(numbers: DataFrame, recent: int) -> DataFrame:
    """Each number's share of the last ``recent`` draws against its share of all, as z."""
    total = numbers.groupBy("lottery").agg(F.max("ord").alias("n"))
    g = numbers.join(F.broadcast(total), "lottery")  # one row a game
    g = g.groupBy("lottery", "num").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"), F.count(F.when(F.col("ord") > F.col("n") - recent, 1)).alias("lately"))
    p = F.col("times") / F.col("n")
    return g.select("lottery", "num", "times", "lately", F.round((F.col("lately") / recent - p) / F.sqrt(p * (1 - p) / recent), 6).alias("z")).where("z is not null")


def previous_overlap(draws: DataFrame) -> DataFrame:
    """Numbers that each draw shares with the draw before; null for a game's first."""
    d = stretched(with_order(draws).select("lottery", "ord", "k", "front"), 1).withColumn("prev", F.lag("front").over(by())).where("not lead")
    return d.select("k", F.when(F.col("prev").isNotNull(), F.size(F.array_intersect("front", "prev")).cast("bigint")).alias("shared"))


# Strategies: tickets for every draw from the draws strictly before it.


def _top(scored: DataFrame, scores: Column, choose: int) -> DataFrame:
    """The ``choose`` numbers with the highest of a draw's scores, picked within the row."""
    order = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), (i.cast("bigint") + 1).alias("num"))))
    d = scored.withColumn("_picks", F.array_sort(F.transform(F.slice(order, 1, choose), lambda x: x["num"])))
    return d.select("lottery", "ord", F.array_join("_picks", "-").alias("numbers"), F.size(F.array_intersect("_picks", "front")).cast("bigint").alias("hits"))


def strategy_hot(draws: DataFrame, size: int, width: int, choose: int) -> DataFrame:
    """The ``choose`` numbers most drawn in the ``width`` draws before, and how many came."""
    return _top(past_counts(draws, size, width), F.col("counts"), choose)


def strategy_overdue(draws: DataFrame, size: int, choose: int) -> DataFrame:
    """The ``choose`` numbers unseen for longest before the draw, and how many came."""
    return _top(omissions(draws, size), F.col("omitted"), choose)


def strategy_hits(draws: DataFrame, size: int, choose: int, hot: dict[str, int], overdue: str) -> DataFrame:
    """(lottery, strategy, ord, hits) of ``strategy_hot`` for the name and width of each of ``hot`` and of ``strategy_overdue`` under the name ``overdue``, by one pass."""
    d = with_last_seen(draws, size, max(hot.values()))

    def work(table: pa.Table) -> dict[str, pa.Array]:
        own, there, counts, _ = windowed(table, size, hot)
        scores = [*counts.values(), omitted(table, own, there)]
        kept = table.take(pa.array(own)).combine_chunks()
        # the highest scores, ties to the smaller number
        best = (np.argpartition(np.arange(size) - s * size, choose - 1, axis=1)[:, :choose] for s in scores)
        return {"lottery": kept["lottery"], "ord": kept["ord"], "hits": arrays(np.stack([np.take_along_axis(there, b, 1).sum(1) for b in best], 1).astype(np.int64))}

    made = by_stretches(d, work, d.select("lottery", "ord", F.lit(None).cast("array<bigint>").alias("hits")).schema)
    names = F.array(*(F.lit(n) for n in (*hot, overdue)))
    return made.select("lottery", "ord", F.explode(F.arrays_zip(names.alias("strategy"), "hits")).alias("x")).select("lottery", "x.strategy", "ord", "x.hits")


def strategy_score(picks: DataFrame, size: int, choose: int, min_train: int) -> DataFrame:
    """Mean hits of a strategy after ``min_train`` draws, with z against random tickets."""
    mean = choose * choose / size
    variance = mean * (size - choose) / size * (size - choose) / (size - 1)
    g = picks.where(F.col("ord") > min_train).groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"))
    return g.select("lottery", "n", "hits", F.round((F.col("hits") / F.col("n") - mean) / F.sqrt(F.lit(variance) / F.col("n")), 6).alias("z"))


def oos_backtest(picks: DataFrame, size: int, choose: int, min_train: int, block: int) -> DataFrame:
    """(lottery, strategy, fold, n, hits, chi2, p): every strategy on every whole block of ``block`` draws after ``min_train``.

    ``picks`` has lottery, strategy, ord and hits of tickets made from strictly
    earlier draws.  The hits of each half of a block are compared with random
    tickets; the squares of both z add up to ``chi2``, whose tail with two
    degrees of freedom is ``p``.
    """
    mean = choose * choose / size
    variance = mean * (size - choose) / size * (size - choose) / (size - 1)
    at = F.col("ord") - min_train - 1
    d = picks.where(at >= 0).select("lottery", "strategy", F.expr(f"(ord - {min_train + 1}) div {block}").alias("fold"), (at % block < block // 2).alias("early"), "hits")
    half = lambda early: F.sum(F.when(F.col("early") == early, F.col("hits")))
    g = d.groupBy("lottery", "strategy", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), half(True).alias("a"), half(False).alias("b")).where(F.col("n") == block)
    z = lambda c, m: (F.col(c) - m * mean) / math.sqrt(m * variance)
    chi2 = z("a", block // 2) * z("a", block // 2) + z("b", block - block // 2) * z("b", block - block // 2)
    return g.select("lottery", "strategy", "fold", "n", "hits", F.round(chi2, 9).alias("chi2"), F.round(F.exp(-F.round(chi2, 9) / 2), 9).alias("p"))
