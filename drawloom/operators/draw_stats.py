"""Aggregates, windows and tests over draws and over their numbers (lottery, num[, ord])."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import by, by_stretches, carried, cells, medians, stretched, upto, with_order


def draw_numbers(draws: DataFrame) -> DataFrame:
    """One row per drawn number, in no order."""
    return draws.select("lottery", F.explode(F.col("front").cast("array<int>")).alias("num"))


def numbered(draws: DataFrame) -> DataFrame:
    """One row per drawn number with the place ``ord`` of its draw."""
    return with_order(draws).select("lottery", "ord", F.explode(F.col("front").cast("array<int>")).alias("num"))


def _domain(numbers: DataFrame, size: int) -> DataFrame:
    return numbers.select("lottery").distinct().select("lottery", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("num"))


def frequency(numbers: DataFrame, size: int) -> DataFrame:
    """Times drawn of every number, zero included."""
    seen = numbers.groupBy("lottery", "num").agg(F.count(F.lit(1)).alias("times"))
    return _domain(numbers, size).join(seen, ["lottery", "num"], "left").fillna(0, ["times"])


def omission(numbers: DataFrame, size: int) -> DataFrame:
    """Draws since each number was last seen; never seen counts all draws."""
    total = numbers.groupBy("lottery").agg(F.max("ord").alias("total"))
    last = numbers.groupBy("lottery", "num").agg(F.max("ord").alias("last"))
    out = _domain(numbers, size).join(last, ["lottery", "num"], "left").join(F.broadcast(total), "lottery")  # one row a game
    return out.select("lottery", "num", (F.col("total") - F.coalesce("last", F.lit(0))).cast("bigint").alias("omitted"))


def hot_cold(freq: DataFrame, n: int) -> DataFrame:
    """The n most and least frequent numbers, ties to the smaller number."""
    w = lambda c: Window.partitionBy("lottery").orderBy(c, "num")
    ranked = freq.withColumn("hot", F.row_number().over(w(F.col("times").desc()))).withColumn("cold", F.row_number().over(w(F.col("times"))))
    kind = F.when(F.col("hot") <= n, "hot").when(F.col("cold") <= n, "cold")
    return ranked.withColumn("kind", kind).where("kind is not null").select("lottery", "kind", F.when(F.col("kind") == "hot", F.col("hot")).otherwise(F.col("cold")).cast("bigint").alias("place"), "num", "times")


def uniformity(freq: DataFrame, per_draw: int) -> DataFrame:
    """Chi-square against equal shares, with Cramer's V and the largest relative deviation."""
    g = freq.groupBy("lottery").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("times") * F.col("times")).alias("sq"), F.max("times").alias("hi"), F.min("times").alias("lo"))
    chi = F.col("sq") * F.col("k") / F.col("n") - F.col("n")
    expected = F.col("n") / F.col("k")
    deviation = F.greatest(F.col("hi") - expected, expected - F.col("lo")) / expected
    return g.select("lottery", "n", (F.col("k") - 1).alias("df"), F.round(chi, 6).alias("chi2"), F.round(F.sqrt(chi / (F.col("n") * (F.col("k") - 1))), 6).alias("v"), F.round(deviation, 6).alias("deviation"))


def co_occurrence(draws: DataFrame) -> DataFrame:
    """Pairs of numbers drawn together, a < b."""
    n = F.array_sort(F.col("front").cast("array<int>"))
    pairs = F.flatten(F.transform(n, lambda x, i: F.transform(F.slice(n, i + 2, F.size(n)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return draws.select("lottery", F.explode(pairs).alias("p")).groupBy("lottery", "p.a", "p.b").agg(F.count(F.lit(1)).alias("times"))


def hits(size: int, numbers: str = "front") -> list[Column]:
    """Whether each of the numbers 1..size was drawn, as 0 and 1."""
    return [F.array_contains(numbers, F.lit(i).cast("bigint")).cast("int") for i in range(1, size + 1)]


def seen(front: pa.ChunkedArray, size: int) -> np.ndarray:
    """Which of the numbers 1..size each row has, a row of booleans each."""
    rows, _, numbers = cells(front)
    fits = (numbers >= 1) & (numbers <= size)
    out = np.zeros((len(front), size), bool)
    out[rows[fits], numbers[fits] - 1] = True
    return out


def arrays(values: np.ndarray) -> pa.ListArray:
    """A matrix as a column of arrays, one a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))


def last_seen(there: np.ndarray, ord: np.ndarray) -> np.ndarray:
    """The draw in which each number came last before each row; 0 if it did not."""
    at = np.maximum.accumulate(np.where(there, ord[:, None], 0), axis=0)
    return np.concatenate([np.zeros((1, there.shape[1]), np.int64), at[:-1]])


def windowed(table: pa.Table, size: int, widths: dict[str, int]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Of a stretch with its lead, in order: its own rows, what they have (``seen``), per width the times each number came in the so many draws before them, and the draws since, at most the greatest width."""
    ord, there = table["ord"].to_numpy(), seen(table["front"], size)
    own = np.flatnonzero(~table["lead"].to_numpy())
    sums = upto(there)
    gaps = np.minimum(ord[own, None] - 1 - last_seen(there, ord)[own], max(widths.values()))
    return own, there[own], {n: sums[own] - sums[np.maximum(own - w, 0)] for n, w in widths.items()}, gaps


def with_lead(draws: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Stretches of draws with as many draws before them as the greatest width."""
    return stretched(with_order(draws).select("lottery", "ord", "front"), max(widths.values()))


def past_windows(draws: DataFrame, size: int, widths: dict[str, int]) -> DataFrame:
    """(lottery, ord, front, *widths, gaps): times each number came in the so many draws before, for every width, by one pass of running sums within stretches.

    gaps are the draws since each number came, at most the greatest width: a
    stretch takes along as many draws of the one before.
    """
    d = with_lead(draws, widths)

    def work(table: pa.Table) -> dict[str, pa.Array]:
        own, _, counts, gaps = windowed(table, size, widths)
        kept = table.take(pa.array(own)).combine_chunks()
        return {n: kept[n] for n in ("lottery", "ord", "front")} | {n: arrays(c) for n, c in counts.items()} | {"gaps": arrays(gaps)}

    schema = d.select("lottery", "ord", "front", *(F.lit(None).cast("array<bigint>").alias(n) for n in (*widths, "gaps"))).schema
    return by_stretches(d, work, schema)


def past_counts(draws: DataFrame, size: int, width: int) -> DataFrame:
    """(lottery, ord, front, counts): times each number came in the ``width`` draws before."""
    return past_windows(draws, size, {"counts": width}).drop("gaps")


def with_last_seen(draws: DataFrame, size: int, lead: int = 0) -> DataFrame:
    """Stretches of draws (with ``lead`` draws before them), and as ``far`` the draw in which each number came last before the stretch's own draws; null if it did not."""
    last = [F.when(h == 1, F.col("ord")).alias(f"_s{i}") for i, h in enumerate(hits(size))]
    d = with_order(draws).select("lottery", "ord", "front")
    names = [f"_s{i}" for i in range(size)]
    far = carried(d.select("lottery", "ord", *last), names).select("lottery", "stretch", F.array(*names).alias("far"))
    return stretched(d, lead).join(far, ["lottery", "stretch"])


def omitted(table: pa.Table, own: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Draws since each number came, before each of a stretch's ``own`` rows (``there``: what they have), with those of ``with_last_seen``."""
    ord = table["ord"].to_numpy()[own]
    _, places, draws = cells(table["far"].slice(0, 1))
    far = np.zeros(there.shape[1], np.int64)
    far[places] = draws
    return ord[:, None] - 1 - np.maximum(last_seen(there, ord), far)


def omissions(draws: DataFrame, size: int) -> DataFrame:
    """(lottery, ord, front, omitted): draws since each number came, before each draw; never seen counts all earlier draws."""
    d = with_last_seen(draws, size)

    def work(table: pa.Table) -> dict[str, pa.Array]:
        return {n: table[n] for n in ("lottery", "ord", "front")} | {"omitted": arrays(omitted(table, np.arange(len(table)), seen(table["front"], size)))}

    return by_stretches(d, work, d.select("lottery", "ord", "front", F.lit(None).cast("array<bigint>").alias("omitted")).schema)


def _by_number(d: DataFrame, values: str, name: str) -> DataFrame:
    return d.select("lottery", "ord", F.posexplode(values).alias("_i", name)).select("lottery", "ord", (F.col("_i") + 1).alias("num"), name)


def rolling_counts(draws: DataFrame, size: int, width: int) -> DataFrame:
    """Times drawn in the last ``width`` draws, the draw itself included, of every draw and number."""
    d = past_counts(draws, size, width - 1)
    now = F.transform("counts", lambda c, i: c + F.array_contains("front", i.cast("bigint") + 1).cast("bigint"))
    return _by_number(d.select("lottery", "ord", now.alias("now")), "now", "times")


def omission_history(draws: DataFrame, size: int) -> DataFrame:
    """Omission of every number before every draw."""
    return _by_number(omissions(draws, size), "omitted", "omitted")


def lag_frame(draws: DataFrame) -> DataFrame:
    """Sales and first winners of the draws before: lags, means of the last 4 and 8, momentum, wins in the last 8, the streak without a first prize, and the calendar."""
    d = with_order(draws).withColumn("_won", F.when(F.col("first_winners") > 0, F.col("ord")))
    back = lambda n: by().rowsBetween(-n, -1)
    mean = lambda n, least: F.when(F.count("sales").over(back(n)) >= least, F.round(F.avg("sales").over(back(n)), 4))
    lag = lambda c, n=1: F.lag(c, n).over(by())
    far = carried(d, ["_won"]).withColumnRenamed("_won", "_far")
    near = F.max("_won").over(by().rowsBetween(Window.unboundedPreceding, -1))
    out = stretched(d, 8).select(
        "lottery", "stretch", "ord", "lead", lag("sales").alias("lag1"), lag("sales", 2).alias("lag2"), mean(4, 2).alias("ma4"), mean(8, 4).alias("ma8"), lag("first_winners").alias("winners1"),
        F.sum((F.col("first_winners") > 0).cast("int")).over(back(8)).cast("bigint").alias("wins8"), near.alias("_near"), F.datediff("draw_date", lag("draw_date")).cast("bigint").alias("days"),
        F.dayofweek("draw_date").cast("bigint").alias("weekday"), F.month("draw_date").cast("bigint").alias("month"), F.round(F.log1p("sales"), 6).alias("log_sales"),
    )
    out = out.where(~F.col("lead")).join(far, ["lottery", "stretch"])
    dry = (F.col("ord") - 1 - F.coalesce(F.greatest("_near", "_far"), F.lit(0))).cast("bigint")
    return out.select("lottery", "ord", "lag1", "lag2", "ma4", "ma8", F.round(F.try_divide(F.col("lag1"), F.col("lag2")) - 1, 6).alias("momentum"), "winners1", "wins8", dry.alias("dry"), "days", "weekday", "month", "log_sales")


def adjacent_repeat(draws: DataFrame, size: int, choose: int) -> DataFrame:
    """Share of draws with a number of the draw before, against C(size - choose, choose) / C(size, choose) for none, as z."""
    d = stretched(with_order(draws).select("lottery", "ord", "front"), 1).withColumn("prev", F.lag("front").over(by())).where("prev is not null and not lead")
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.arrays_overlap("front", "prev"), 1)).alias("repeats"))
    p = 1.0
    for i in range(choose):
        p *= (size - choose - i) / (size - i)
    p = 1 - p
    share = F.col("repeats") / F.col("n")
    return g.select("lottery", "n", "repeats", F.round((share - p) / F.sqrt(F.lit(p * (1 - p)) / F.col("n")), 6).alias("z"), F.round((share - p) / p, 6).alias("effect"))


def serial_correlation(draws: DataFrame) -> DataFrame:
    """Lag-1 correlation of each position of the sorted numbers, with its t and whether it is of practical size."""
    d = stretched(with_order(draws).select("lottery", "ord", "front"), 1).withColumn("prev", F.lag("front").over(by())).where("prev is not null and not lead")
    d = d.select("lottery", F.posexplode(F.arrays_zip(F.col("front").alias("x"), F.col("prev").alias("y"))).alias("pos", "z"))
    g = d.groupBy("lottery", "pos").agg(F.count(F.lit(1)).alias("n"), F.corr("z.x", "z.y").alias("_r"))
    return g.select("lottery", "pos", "n", F.round("_r", 6).alias("r"), F.round(F.col("_r") * F.sqrt((F.col("n") - 2) / (1 - F.col("_r") * F.col("_r"))), 5).alias("t"), (F.abs("_r") > 0.10).alias("practical"))


def runs_test(draws: DataFrame) -> DataFrame:
    """Wald-Wolfowitz runs of sales above and not above the median."""
    d = with_order(draws).join(F.broadcast(medians(draws, ["lottery"], "sales")), "lottery").withColumn("up", (F.col("sales") > F.col("middle")).cast("int"))  # one row a game
    d = stretched(d.select("lottery", "ord", "up"), 1).withColumn("turn", (F.col("up") != F.lag("up").over(by())).cast("int")).where("not lead")
    g = d.groupBy("lottery").agg((F.sum("turn") + 1).alias("runs"), F.sum("up").alias("n1"), F.sum(1 - F.col("up")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # their product thrice fits in no long from 2.1 million draws on
    mean = 2.0 * n1 * n2 / (n1 + n2) + 1
    var = 2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))
    return g.select("lottery", "runs", "n1", "n2", F.round((F.col("runs") - mean) / F.sqrt(var), 6).alias("z"))


def bh_adjust(df: DataFrame, p: str, family: list[str], key: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family."""
    up = Window.partitionBy(*family).orderBy(F.col(p), *key)
    down = Window.partitionBy(*family).orderBy(F.col(p).desc(), *(F.col(k).desc() for k in key)).rowsBetween(Window.unboundedPreceding, 0)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = df.withColumn("_raw", F.col(p) * m / F.row_number().over(up))
    return raw.withColumn("p_adjusted", F.round(F.least(F.lit(1.0), F.min("_raw").over(down)), 9)).drop("_raw")


def grouping_counts(sources: DataFrame) -> DataFrame:
    """Draw counts by game, year and source, by game and year, by game and over all, in one pass."""
    return sources.rollup("lottery", "issue_year", "source").agg(F.count(F.lit(1)).alias("draws"), F.sum("sales").alias("sales"))


def companion(draws: DataFrame, size: int, window: int, top: int = 5) -> DataFrame:
    """Per game and number: mean share of its last ``window`` draws in which the number came with each of the ``top`` hottest of them (itself left out)."""
    w = Window.partitionBy("lottery").orderBy(F.col("issue_year").desc(), F.col("issue_seq").desc())
    last = draws.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= window).select("lottery", "front")  # a top-n of each task first
    hot = hot_cold(frequency(draw_numbers(last), size), top).where("kind = 'hot'").groupBy("lottery").agg(F.collect_list("num").alias("hot"))
    n = last.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))
    d = last.join(F.broadcast(hot), "lottery").select("lottery", "hot", "front", F.explode("front").alias("num"))  # one row a game
    with_ = F.size(F.filter("hot", lambda t: (t != F.col("num")) & F.array_contains("front", t.cast("bigint"))))
    seen = d.select("lottery", F.col("num").cast("int").alias("num"), with_.alias("c")).groupBy("lottery", "num").agg(F.sum("c").alias("c"))
    every = _domain(last, size).join(seen, ["lottery", "num"], "left").join(F.broadcast(n), "lottery").join(F.broadcast(hot), "lottery")
    others = top - F.array_contains("hot", F.col("num")).cast("int")
    return every.select("lottery", "num", F.round(F.coalesce("c", F.lit(0)) / others / F.col("n"), 6).alias("rate"))


def adjusted(df: DataFrame, p: str, family: list[str], key: list[str]) -> DataFrame:
    """``bh_adjust`` with the Bonferroni and Sidak bounds of the family beside it."""
    m = F.count(F.col(p)).over(Window.partitionBy(*family))
    out = bh_adjust(df, p, family, key).withColumn("_m", m)
    return out.withColumn("bonferroni", F.round(F.least(F.lit(1.0), F.col(p) * F.col("_m")), 9)).withColumn("sidak", F.round(1 - F.pow(1 - F.col(p), F.col("_m")), 9)).drop("_m")
