"""Tests on draws: independence, drift, change points, sequential evidence, ranks and resampled nulls.

Results are one row per game (and position, lag or number) with the statistic
and, as column ``p``, its tail probability.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .draw_stats import hits, past_counts
from .order import by, stretched, summed, with_order
from .permuted import by_parts, ends_of_runs, reach_of_sums

GAMES = ["lottery"]


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def with_p(df: DataFrame, p: Column) -> DataFrame:
    """``df`` with ``p``; its other columns stay as they are."""
    return df.withColumn("p", p)


def uniformity_p(tested: DataFrame) -> DataFrame:
    """``draw_stats.uniformity``, ``serial_pairs``, ``block_frequency`` or ``benford`` with chi-square tail ``p``; benford's df is 8."""
    df = F.col("df") if "df" in tested.columns else F.lit(8)
    return with_p(tested, special.chi2_sf(F.col("chi2"), df.cast("double")))


# --- positions within a draw ----------------------------------------------


def _position_pairs(draws: DataFrame, digits: str) -> DataFrame:
    """(lottery, i, j, x, y, c): counts of the values of each two positions, i < j, built within the row."""
    d = F.col(digits)
    pairs = F.flatten(F.transform(d, lambda x, i: F.transform(F.slice(d, i + 2, F.size(d)), lambda y, k: F.struct(i.alias("i"), (i + 1 + k).alias("j"), x.alias("x"), y.alias("y")))))
    return draws.select("lottery", F.explode(pairs).alias("p")).groupBy("lottery", "p.i", "p.j", "p.x", "p.y").agg(F.count(F.lit(1)).alias("c"))


def _with_margins(pairs: DataFrame) -> DataFrame:
    """Pair counts with the counts ``cx`` and ``cy`` of their values and the draws ``n`` (a row per pair of values: bounded by the game)."""
    key = ["lottery", "i", "j"]
    over = lambda *more: F.sum("c").over(Window.partitionBy(*key, *more))
    return pairs.select("*", over("x").alias("cx"), over("y").alias("cy"), over().alias("n"))


def same_rate(draws: DataFrame, digits: str = "digits") -> DataFrame:
    """Draws with the same value at two positions, against the product of the shares; practical from |z| 3 on."""
    pairs = _with_margins(_position_pairs(draws, digits))
    key = ["lottery", "i", "j"]
    margin = lambda v, c: pairs.select(*key, F.col(v).alias("v"), F.col(c).alias(c), "n").distinct()
    expected = margin("x", "cx").join(margin("y", "cy").drop("n"), [*key, "v"]).groupBy(*key).agg((F.sum(F.col("cx") * F.col("cy") / F.col("n") / F.col("n"))).alias("e"))
    g = pairs.groupBy(*key).agg(F.max("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same")).join(expected, key)
    z = F.try_divide(F.col("same") / F.col("n") - F.col("e"), F.sqrt(F.col("e") * (1 - F.col("e")) / F.col("n")))
    out = g.select(*key, "n", "same", F.round("e", 6).alias("expected"), F.round(z, 5).alias("z"), (F.abs(z) >= 3).alias("practical"))
    return with_p(out, special.norm_two_sided("z"))


def position_independence(draws: DataFrame, digits: str = "digits") -> DataFrame:
    """Chi-square of the contingency table of two positions, with Cramer's V and the least expected count; values never seen have no row or column."""
    pairs = _with_margins(_position_pairs(draws, digits))
    key = ["lottery", "i", "j"]
    g = pairs.groupBy(*key).agg(F.max("n").alias("n"), F.sum(F.col("c") * F.col("c") / (F.col("cx") * F.col("cy"))).alias("s"), F.countDistinct("x").alias("r"), F.countDistinct("y").alias("k"), F.min("cx").alias("lx"), F.min("cy").alias("ly"))
    chi = F.col("n") * (F.col("s") - 1)
    v = F.sqrt(chi / (F.col("n") * (F.least("r", "k") - 1)))
    out = g.where("r > 1 and k > 1").select(*key, "n", F.round(chi, 5).alias("chi2"), ((F.col("r") - 1) * (F.col("k") - 1)).alias("df"), F.round(v, 6).alias("v"), F.round(F.col("lx") * F.col("ly") / F.col("n"), 5).alias("least_expected"))
    return with_p(out, special.chi2_sf(F.col("chi2"), F.col("df").cast("double")))


def diagonal_gain(draws: DataFrame, values: int, alpha: float = 0.05, digits: str = "digits") -> DataFrame:
    """Largest gain of betting on equal values at two positions over independence, and its simultaneous upper bound."""
    key = ["lottery", "i", "j"]
    t = special._NORMAL.inv_cdf((1 - alpha) ** (1 / values))
    pairs = _with_margins(_position_pairs(draws, digits)).where("x = y")
    base = F.col("cx") / F.col("n") * (F.col("cy") / F.col("n"))
    share = F.col("c") / F.col("n")
    g = pairs.groupBy(*key).agg(F.max(share / base).alias("gain"), F.max((share + t * F.sqrt(base * (1 - base) / F.col("n"))) / base).alias("bound"))
    return g.select(*key, F.round("gain", 6).alias("gain"), F.round("bound", 6).alias("bound"))


# --- windows over draws -----------------------------------------------------


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once a row: inside lambdas the optimizer would put its whole expression in every place it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, c: a + c)


def sliding_chi2(draws: DataFrame, size: int, width: int, p: float) -> DataFrame:
    """Windows of ``width`` draws whose numbers are uneven at level ``p``: chi-square, largest relative deviation, the three hottest and coldest numbers."""
    counts = F.transform("counts", lambda c, i: c + F.array_contains("front", i.cast("bigint") + 1).cast("bigint"))
    uneven = lambda c, e: F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - e) * (x - e) / e)
    window = once(counts, lambda c: once(_total(c) / size, lambda e: F.struct(c.alias("counts"), e.alias("e"), uneven(c, e).alias("chi2"))))
    d = past_counts(draws, size, width - 1).where(F.col("ord") >= width).select("lottery", "ord", window.alias("w"))
    d = d.where(F.col("w.chi2") > special.chi2_quantile(1 - p, size - 1))

    def described(w: Column) -> Column:
        by = lambda sign: F.array_sort(F.filter(F.transform(w["counts"], lambda c, i: F.struct((c * sign).alias("k"), (i + 1).alias("num"))), lambda x: x["k"] * sign * sign < w["e"] * sign))
        three = lambda sign: F.array_join(F.transform(F.slice(by(sign), 1, 3), lambda x: x["num"]), "-")
        deviation = F.array_max(F.transform(w["counts"], lambda c: F.abs(c - w["e"]))) / F.greatest(w["e"], F.lit(1))
        return once(deviation, lambda v: F.struct(F.round(w["chi2"], 5).alias("chi2"), F.round(v, 5).alias("deviation"), (v > 0.8).alias("severe"), three(-1).alias("hot"), three(1).alias("cold")))

    return d.select("lottery", "ord", once(F.col("w"), described).alias("w")).select("lottery", "ord", "w.*")


#: Half-open thirds of a 33-number zone as they are compared.
THIRDS = ((1, 11), (11, 22), (22, 34))


def zone_deviation(draws: DataFrame, size: int = 33, width: int = 50, z: float = 2.0, bounds=THIRDS) -> DataFrame:
    """Windows in which a sub-range is over 30 % off an equal share and the root of chi-square exceeds ``z``."""
    counts = F.transform("counts", lambda c, i: c + F.array_contains("front", i.cast("bigint") + 1).cast("bigint"))
    parts = lambda c: F.array(*(_total(F.slice(c, lo, hi - lo)) for lo, hi in bounds))

    def described(p: Column, e: Column) -> Column:
        most = F.array_max(F.transform(p, lambda x: F.abs(x - e) / F.greatest(e, F.lit(1))))
        root = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - e) * (x - e) / F.greatest(e, F.lit(1))))
        return F.struct(p.alias("parts"), most.alias("most"), root.alias("root"))

    window = once(once(counts, parts), lambda p: once(_total(p) / len(bounds), lambda e: described(p, e)))
    d = past_counts(draws, size, width - 1).where(F.col("ord") >= width).select("lottery", "ord", window.alias("w"))
    d = d.where((F.col("w.most") > 0.3) & (F.col("w.root") > z))
    return d.select("lottery", "ord", once(F.col("w"), lambda w: F.struct(F.array_join(w["parts"], "-").alias("parts"), F.round(w["most"], 5).alias("deviation"), F.round(w["root"], 5).alias("z"), (w["most"] > 0.6).alias("severe"))).alias("w")).select("lottery", "ord", "w.*")


def _moments(d: DataFrame, value: str) -> DataFrame:
    return F.broadcast(d.groupBy("lottery").agg(F.avg(value).alias("_mean"), F.nullif(F.stddev_pop(value), F.lit(0.0)).alias("_dev"), F.count(F.lit(1)).alias("_n")))  # one row a game


def extreme_runs(draws: DataFrame, run: Column, rare: int, top: int) -> DataFrame:
    """The ``top`` draws of a game with the longest runs of ``rare`` or more, with z against all its draws."""
    d = draws.select("lottery", "issue_year", "issue_seq", run.alias("run"))
    d = d.join(_moments(d, "run"), "lottery").where(F.col("run") >= rare)
    w = Window.partitionBy("lottery").orderBy(F.col("run").desc(), "issue_year", "issue_seq")
    return d.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top).select("lottery", "issue_year", "issue_seq", "run", "place", F.round((F.col("run") - F.col("_mean")) / F.col("_dev"), 5).alias("z"))


def run_clusters(draws: DataFrame, run: Column, width: int = 15) -> DataFrame:
    """Windows of ``width`` draws in which more have a run of two or longer than in 95 % of windows (4 at least); severe beyond 99 %."""
    d = stretched(with_order(draws).select("lottery", "ord", (run >= 2).cast("int").alias("x")), width - 1)
    d = d.withColumn("n", F.sum("x").over(by().rowsBetween(-width + 1, 0))).where((F.col("ord") >= width) & ~F.col("lead"))
    # few distinct counts: the percentiles' state is small
    limits = d.groupBy("lottery").agg(F.percentile("n", F.array(F.lit(0.95), F.lit(0.99))).alias("q"))
    d = d.join(F.broadcast(limits), "lottery").where(F.col("n") > F.greatest(F.col("q")[0], F.lit(4.0)))  # one row a game
    return d.select("lottery", "ord", "n", (F.col("n") > F.col("q")[1]).alias("severe"))


def best_clusters(clusters: DataFrame, width: int = 15, top: int = 10) -> DataFrame:
    """The ``top`` windows of each game among ``run_clusters`` that do not overlap: fullest first, of equals the earliest, each that touches none taken before.

    Windows that touch each other, over others or not, form an island, and what
    is taken in one says nothing of another; islands are settled in parallel.
    Only windows over the gate are in them, a twentieth of a game's at most.
    """
    d = stretched(clusters, width - 1).withColumn("new", F.coalesce((F.col("ord") - F.lag("ord").over(by()) >= width).cast("int"), F.lit(1))).where("not lead").drop("lead", "stretch")
    before = summed(d, ["new"]).withColumnRenamed("new", "before")
    within = F.sum("new").over(by().rowsBetween(Window.unboundedPreceding, 0))
    placed = stretched(d).join(before, ["lottery", "stretch"]).withColumn("island", within + F.col("before"))

    def settle(part: pa.Table) -> pa.Table:
        at, n = part.column("ord").to_numpy(), part.column("n").to_numpy()
        taken: list[int] = []
        for i in np.lexsort((at, -n)):
            place = bisect.bisect(taken, at[i])
            if (place == 0 or at[i] - taken[place - 1] >= width) and (place == len(taken) or taken[place] - at[i] >= width):
                taken.insert(place, int(at[i]))
        return part.filter(pa.array(np.isin(at, taken))).select(["lottery", "ord", "n", "severe"])

    kept = placed.select("lottery", "island", "ord", "n", "severe").groupBy("lottery", "island").applyInArrow(settle, "lottery string, ord bigint, n bigint, severe boolean")
    w = Window.partitionBy("lottery").orderBy(F.col("n").desc(), "ord")
    return kept.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top)



def shape_anomaly(draws: DataFrame, z: float = 2.5) -> DataFrame:
    """Draws whose span is ``z`` deviations off the mean: clustered or spread, with least and largest gap."""
    s = F.array_sort("front")
    gaps = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.element_at(s, i + 1) - F.element_at(s, i))
    d = draws.select("lottery", "issue_year", "issue_seq", (F.element_at(s, -1) - F.element_at(s, 1)).alias("span"), F.array_min(gaps).alias("min_gap"), F.array_max(gaps).alias("max_gap"))
    d = d.join(_moments(d, "span"), "lottery").withColumn("z", (F.col("span") - F.col("_mean")) / F.col("_dev")).where(F.abs("z") > z)
    return d.select("lottery", "issue_year", "issue_seq", "span", "min_gap", "max_gap", F.round("z", 5).alias("z"), F.when(F.col("z") < 0, "clustered").otherwise("spread").alias("shape"))


def periodicity(draws: DataFrame, value: Column, lags: int = 30) -> DataFrame:
    """(lottery, lag, r): mean product of deviations at each lag over the sum of squares."""
    d = with_order(draws).select("lottery", "ord", value.alias("x"))
    d = d.join(_moments(d, "x"), "lottery").withColumn("x", F.col("x") - F.col("_mean")).drop("_mean", "_dev")
    s = stretched(d, lags).select("lottery", "lead", "_n", "x", *(F.lag("x", i).over(by()).alias(f"l{i}") for i in range(1, lags + 1))).where("not lead")
    g = s.groupBy("lottery").agg(F.max("_n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("ss"), *(F.sum(F.col("x") * F.col(f"l{i}")).alias(f"c{i}") for i in range(1, lags + 1)))
    out = g.select("lottery", F.explode(F.array(*(F.struct(F.lit(i).alias("lag"), F.try_divide(F.col(f"c{i}"), (F.col("n") - i) * F.col("ss")).alias("r")) for i in range(1, lags + 1)))).alias("x"))
    return out.select("lottery", "x.lag", F.round("x.r", 9).alias("r"))


def regular_numbers(numbered: DataFrame, least: float = 8.0, most_cv: float = 0.25) -> DataFrame:
    """Numbers that come at near-equal distances: mean gap ``least`` or more and deviation under ``most_cv`` of it."""
    w = Window.partitionBy("lottery", "num").orderBy("ord")
    g = numbered.withColumn("gap", F.col("ord") - F.lag("ord").over(w)).where("gap is not null").groupBy("lottery", "num").agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    return g.select("lottery", "num", "gaps", F.round("m", 6).alias("mean"), F.round(F.col("s") / F.col("m"), 6).alias("cv"), ((F.col("m") >= least) & (F.col("s") / F.col("m") < most_cv)).alias("regular"))


# --- drift and change -------------------------------------------------------


def change_point(draws: DataFrame, size: int, min_seg: int = 200) -> DataFrame:
    """The split of a game's bonus numbers with the largest two-segment chi-square, of equals the first; V of 0.1 or more is practical."""
    names = [f"h{i}" for i in range(size)]
    d = with_order(draws).select("lottery", "ord", *(c.cast("bigint").alias(n) for c, n in zip(hits(size, "back"), names, strict=True)))
    totals = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(n) for n in names)).alias("t"))
    before = summed(d, names).select("lottery", "stretch", *(F.col(n).alias(f"b{n}") for n in names))
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    s = stretched(d).select("lottery", "stretch", "ord", *(F.sum(n).over(upto).alias(n) for n in names)).join(before, ["lottery", "stretch"]).join(F.broadcast(totals), "lottery")  # one row a game
    s = s.where((F.col("ord") >= min_seg) & (F.col("ord") <= F.col("n") - min_seg)).select("lottery", "ord", "n", "t", F.array(*(F.col(n) + F.col(f"b{n}") for n in names)).alias("f"))
    part = F.zip_with("f", "t", lambda f, t: F.when(t > 0, (f - F.col("ord") * t / F.col("n")) * (f - F.col("ord") * t / F.col("n")) * (F.col("n") * F.col("n")) / (t * F.col("ord") * (F.col("n") - F.col("ord")))).otherwise(0.0))
    s = s.withColumn("chi2", F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), 6))
    best = s.groupBy("lottery").agg(F.max(F.struct("chi2", (-F.col("ord")).alias("at"), "n")).alias("b"))
    v = F.sqrt(F.col("b.chi2") / F.col("b.n"))
    return best.select("lottery", (-F.col("b.at")).alias("split"), F.col("b.n").alias("n"), F.round("b.chi2", 5).alias("chi2"), F.round(v, 6).alias("v"), (v >= 0.1).alias("practical"))


def replicates(series: DataFrame, order: str, B: int, seed: int) -> DataFrame:
    """``series`` once as it is (replicate 0, ``turn`` by ``order``) and B times in the order of an md5 of seed, replicate and order.

    A replicate's order depends on nothing but these, so replicates are the same
    however rows are spread; they are ordered by windows of (game, replicate),
    which spill.
    """
    r = series.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(B))))
    plain = F.lpad(F.col(order).cast("string"), 32, "0")
    return r.withColumn("turn", F.when(F.col("replicate") == 0, plain).otherwise(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(order).cast("string")))))


def permute_null(stats: DataFrame, key: list[str], value: str) -> DataFrame:
    """(*key, observed, replicates, reached, p, q95, q99) from (*key, replicate, value): p = (1 + those at least as large) / (1 + B)."""
    drawn = F.when(F.col("replicate") > 0, F.col(value))
    g = stats.dropna(subset=key).groupBy(*key).agg(
        F.max(F.when(F.col("replicate") == 0, F.col(value))).alias("observed"), F.count(F.when(F.col("replicate") > 0, 1)).alias("replicates"), F.percentile(drawn, F.array(F.lit(0.95), F.lit(0.99))).alias("q"), F.collect_list(drawn).alias("drawn")
    )
    # the replicates' values are few and stay in the row: the statistics are worked out once
    g = g.where("replicates > 0").withColumn("reached", F.size(F.filter("drawn", lambda v: v >= F.col("observed"))).cast("bigint"))
    return g.select(*key, "observed", "replicates", "reached", F.round((F.col("reached") + 1) / (F.col("replicates") + 1), 6).alias("p"), F.round(F.col("q")[0], 6).alias("q95"), F.round(F.col("q")[1], 6).alias("q99"))


#: Draws in a part of the replicate in the draws' own order; an md5 order has a part for each beginning of three digits.
OWN_PART = 2048


def replicate_parts(series: DataFrame, order: str, B: int, seed: int) -> DataFrame:
    """``replicates`` with the ``part`` of its order that a row is in; parts follow each other as text, and ``turn`` orders within them.

    One row a draw and replicate: for few draws.  ``permuted.by_parts`` measures
    long series in the same orders without such rows.
    """
    spread = series.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lottery", order)  # else few small partitions would make all replicates
    r = spread.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(B))))
    r = r.withColumn("_md5", F.when(F.col("replicate") > 0, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(order).cast("string")))))
    part = F.coalesce(F.substring("_md5", 1, 3), F.lpad(F.expr(f"{order} div {OWN_PART}").cast("string"), 20, "0"))
    return r.withColumns({"part": part, "turn": F.unhex(F.coalesce(F.substring("_md5", 3, 30), F.lpad(F.hex(order), 30, "0")))}).drop("_md5", order)


def longest_run(draws: DataFrame, B: int = 99, seed: int = 7) -> DataFrame:
    """The longest run of one bonus number, against permuted draws; over the 99 % quantile of them is out of gate."""
    d = with_order(draws).select("lottery", "ord", F.element_at("back", 1).alias("x"))
    # only the first and last runs of parts can go on
    ends = by_parts(d, B, seed, ends_of_runs, "inner bigint, run bigint, x bigint, n bigint")
    over = Window.partitionBy("lottery", "replicate").orderBy("part", "run")  # two rows a part
    ends = ends.withColumn("starts", F.coalesce((F.col("run") > 1) | (F.lag("x").over(over) != F.col("x")), F.lit(True)).cast("int")).withColumn("chain", F.sum("starts").over(over))
    longest = ends.groupBy("lottery", "replicate", "chain").agg(F.sum("n").alias("n"), F.max("inner").alias("inner")).groupBy("lottery", "replicate").agg(F.greatest(F.max("n"), F.max("inner")).alias("longest"))
    return permute_null(longest, GAMES, "longest").withColumn("out_of_gate", F.col("observed") > F.col("q99"))


def cusum(draws: DataFrame, middle: DataFrame, B: int = 99, seed: int = 7) -> DataFrame:
    """Largest absolute partial sum of +1 above and -1 at or under the median of sales, against permuted draws; ``middle`` holds the medians."""
    d = with_order(draws).join(F.broadcast(middle), "lottery").select("lottery", "ord", F.when(F.col("sales") > F.col("middle"), 1).otherwise(-1).alias("x"))  # one row a game
    per = by_parts(d, B, seed, reach_of_sums, "sum bigint, lo bigint, hi bigint")
    earlier = Window.partitionBy("lottery", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = F.coalesce(F.sum("sum").over(earlier), F.lit(0))
    sums = per.select("lottery", "replicate", F.greatest(F.abs(F.col("lo") + before), F.abs(F.col("hi") + before)).alias("most")).groupBy("lottery", "replicate").agg(F.max("most").alias("most"))
    return permute_null(sums, GAMES, "most")


def js_drift(draws: DataFrame, recent: int = 30, base: int = 150, B: int = 99, seed: int = 7, alpha: float = 0.05, margin: float = 0.25) -> DataFrame:
    """Jensen-Shannon divergence of the numbers of the ``recent`` last draws from the ``base`` before, against random splits of those draws.

    An alarm needs p at most ``alpha`` and ``margin`` over the 95 % quantile.
    """
    w = Window.partitionBy("lottery").orderBy(F.col("issue_year").desc(), F.col("issue_seq").desc())
    last = draws.withColumn("age", F.row_number().over(w)).where(F.col("age") <= recent + base).select("lottery", "age", "front")
    turn = F.row_number().over(Window.partitionBy("lottery", "replicate").orderBy("turn"))
    d = replicates(last, "age", B, seed).withColumn("new", turn <= recent).select("lottery", "replicate", "new", F.explode("front").alias("num"))
    c = d.groupBy("lottery", "replicate", "num").agg(F.count(F.when(F.col("new"), 1)).alias("a"), F.count(F.when(~F.col("new"), 1)).alias("b"))
    every = Window.partitionBy("lottery", "replicate")
    c = c.withColumn("p", F.col("a") / F.sum("a").over(every)).withColumn("q", F.col("b") / F.sum("b").over(every))
    m = (F.col("p") + F.col("q")) / 2
    kl = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    js = c.groupBy("lottery", "replicate").agg(F.round(F.sum((kl(F.col("p")) + kl(F.col("q"))) / 2), 9).alias("js"))
    out = permute_null(js, GAMES, "js")
    return out.withColumn("alarm", (F.col("p") <= alpha) & (F.col("observed") >= (1 + margin) * F.col("q95")))


def mutual_information(draws: DataFrame, lags: int = 3) -> DataFrame:
    """(lottery, lag, nats): information of the bonus number ``lag`` draws before about the next one, beyond the one just before for lags from 2 on."""
    x = with_order(draws).select("lottery", "ord", F.element_at("back", 1).alias("x0"))
    d = stretched(x, lags).select("lottery", "lead", "ord", "x0", *(F.lag("x0", i).over(by()).alias(f"x{i}") for i in range(1, lags + 1))).where(~F.col("lead") & (F.col("ord") > lags))

    def entropy(*names: str) -> DataFrame:
        c = d.groupBy("lottery", *names).agg(F.count(F.lit(1)).alias("c"))
        g = c.groupBy("lottery").agg(F.sum("c").alias("n"), F.sum(_xlogx(F.col("c").cast("double"))).alias("s"))
        return g.select("lottery", (F.ln("n") - F.col("s") / F.col("n")).alias("h"))

    def total(*parts: tuple[int, tuple[str, ...]]) -> DataFrame:
        out = None
        for sign, names in parts:
            e = entropy(*names).select("lottery", (F.col("h") * sign).alias("h"))
            out = e if out is None else out.unionByName(e)
        return out.groupBy("lottery").agg(F.round(F.sum("h"), 6).alias("nats"))

    out = total((1, ("x0",)), (1, ("x1",)), (-1, ("x0", "x1"))).withColumn("lag", F.lit(1))
    for k in range(2, lags + 1):
        more = total((1, ("x0", "x1")), (1, (f"x{k}", "x1")), (-1, ("x1",)), (-1, ("x0", "x1", f"x{k}")))
        out = out.unionByName(more.withColumn("lag", F.lit(k)))
    return out


# --- sequential evidence ------------------------------------------------------


def e_process(draws: DataFrame, size: int, choose: int, warm: int = 200, c: float = 0.3, alpha: float = 0.05, eps: float = 1e-3) -> DataFrame:
    """Per game: log of the mean wealth over all numbers at the end, its largest, and the first draw at which it reaches 1 / alpha.

    A number's bet at a draw follows from the draws strictly before; the first
    ``warm`` draws are not bet on.
    """
    p0 = choose / size
    lo, hi, spread = -(1 - eps) / (1 - p0), (1 - eps) / p0, p0 * (1 - p0)
    names = [f"h{i}" for i in range(size)]
    d = with_order(draws).select("lottery", "ord", *(h.cast("bigint").alias(n) for h, n in zip(hits(size), names, strict=True)))
    before = summed(d, names).select("lottery", "stretch", *(F.col(n).alias(f"b{n}") for n in names))
    past = by().rowsBetween(Window.unboundedPreceding, -1)
    s = stretched(d).select("lottery", "stretch", "ord", *names, *(F.coalesce(F.sum(n).over(past), F.lit(0)).alias(f"c{n}") for n in names)).join(before, ["lottery", "stretch"])
    share = lambda n: (F.col(f"c{n}") + F.col(f"b{n}")) / (F.col("ord") - 1)
    bet = lambda n: F.greatest(F.lit(lo), F.least(F.lit(hi), (share(n) - p0) * (c / spread)))
    gain = lambda n: F.when(F.col("ord") - 1 >= warm, F.ln(1 + bet(n) * (F.col(n) - p0))).otherwise(0.0)
    logs = s.select("lottery", "ord", *(gain(n).alias(n) for n in names))
    earlier = summed(logs, names).select("lottery", "stretch", *(F.col(n).alias(f"b{n}") for n in names))
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    w = stretched(logs).select("lottery", "stretch", "ord", *(F.sum(n).over(upto).alias(n) for n in names)).join(earlier, ["lottery", "stretch"])
    w = w.select("lottery", "ord", F.array(*(F.col(n) + F.col(f"b{n}") for n in names)).alias("logs")).withColumn("top", F.array_max("logs"))
    # the largest is taken out before the powers, which no double would hold in a long history
    wealth = F.col("top") + F.ln(F.aggregate("logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top"))) / size)
    w = w.select("lottery", "ord", wealth.alias("w"))
    g = w.groupBy("lottery").agg(F.max_by("w", "ord").alias("last"), F.max("w").alias("most"), F.min(F.when(F.col("w") >= math.log(1 / alpha), F.col("ord"))).alias("crossed"))
    return g.select("lottery", F.round("last", 5).alias("last"), F.round("most", 5).alias("most"), "crossed")


def sign_evidence(pairs: DataFrame, c: float = 0.5) -> DataFrame:
    """(lottery, difference) pairs: wins, losses, log wealth of betting ``c`` on each sign, and the exact two-sided ``p``."""
    g = pairs.groupBy("lottery").agg(F.count(F.when(F.col("difference") > 0, 1)).alias("wins"), F.count(F.when(F.col("difference") < 0, 1)).alias("losses"))
    log = F.col("wins") * math.log1p(c) + F.col("losses") * math.log1p(-c)
    out = g.select("lottery", "wins", "losses", F.round(log, 6).alias("log_wealth"))
    return with_p(out, special.binom_test(F.col("wins").cast("double"), (F.col("wins") + F.col("losses")).cast("double"), F.lit(0.5)))


# --- ranks --------------------------------------------------------------------


def average_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the average rank of ``value`` within ``group``; distinct values are put in order by ranges of values."""
    counts = df.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    d = counts.join(ends, group).withColumn("_range", F.floor((F.col("_v") - F.col("_lo")) * 512.0 / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))))
    per = d.groupBy(*group, "_range").agg(F.sum("_c").alias("_in"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    per = per.select(*group, "_range", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = d.join(per, [*group, "_range"]).select(*group, "_v", (F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)) + (F.col("_c") + 1) / 2).alias(name), F.col("_c").alias(f"{name}_ties"))
    return df.withColumn("_v", F.col(value)).join(ranks, [*group, "_v"]).drop("_v")


def mann_whitney(df: DataFrame, value: str, flag: str) -> DataFrame:
    """(lottery, n1, n2, u, z): whether ``value`` is larger where ``flag`` holds, one-sided, ties corrected."""
    d = average_ranks(df.where(F.col(value).isNotNull()), GAMES, value, "rank")
    g = d.groupBy("lottery").agg(F.count(F.when(F.col(flag), 1)).alias("n1"), F.count(F.when(~F.col(flag), 1)).alias("n2"), F.sum(F.when(F.col(flag), F.col("rank"))).alias("r"), F.sum(F.col("rank_ties") * F.col("rank_ties") - 1).alias("ties"), F.avg(F.when(F.col(flag), F.col(value))).alias("a"), F.avg(F.when(~F.col(flag), F.col(value))).alias("b"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0))))
    out = g.select("lottery", "n1", "n2", F.round(u, 1).alias("u"), F.round(F.try_divide(u - n1 * n2 / 2 - 0.5, sd), 5).alias("z"), F.round("a", 6).alias("mean1"), F.round("b", 6).alias("mean2"))
    return with_p(out, special.norm_sf("z"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns per game, with t and its two-sided ``p``."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("lottery", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = average_ranks(average_ranks(d, GAMES, "x", "rx"), GAMES, "y", "ry")
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("r"))
    out = g.select("lottery", "n", F.round("r", 6).alias("rho"), F.round(F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))), 4).alias("t"))
    return with_p(out, special.t_sf(F.col("t"), (F.col("n") - 2).cast("double")))


def goodness_of_fit(df: DataFrame, observed: str, weight: str, group: list[str]) -> DataFrame:
    """Chi-square of observed counts against shares of ``weight``."""
    every = Window.partitionBy(*group)  # one row a category
    d = df.withColumn("_e", F.sum(observed).over(every).cast("double") * F.col(weight) / F.sum(weight).over(every)).where(F.col("_e") > 0)
    g = d.groupBy(*group).agg(F.round(F.sum((F.col(observed) - F.col("_e")) * (F.col(observed) - F.col("_e")) / F.col("_e")), 5).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return with_p(g, special.chi2_sf(F.col("chi2"), F.col("df").cast("double")))


# --- ratios with block bootstrap ------------------------------------------------

_PRIME, _STEP = 2_147_483_647, 48_271
#: Starts of a replicate that one row becomes.
PIECE = 8192


def block_bootstrap(series: DataFrame, sums: list[str], block: int, B: int, seed: int) -> DataFrame:
    """(lottery, replicate, *sums): sums over circular blocks drawn with replacement, as many as cover the series.

    Sums of every possible block come from one window; a replicate adds up the
    blocks at its starts, which follow from (seed, replicate, place) by a
    multiplicative generator.
    """
    d = with_order(series).select("lottery", "ord", *sums)
    n = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))
    round_ = d.join(F.broadcast(n), "lottery").where(F.col("ord") > F.col("n") - block + 1).withColumn("ord", F.col("ord") - F.col("n")).drop("n")  # one row a game
    ring = d.unionByName(round_).withColumn("ord", F.col("ord") + block)
    frame = by().rowsBetween(-block + 1, 0)
    blocks = stretched(ring, block - 1).select("lottery", "lead", "ord", *(F.sum(c).over(frame).alias(c) for c in sums)).where(~F.col("lead") & (F.col("ord") > block))
    blocks = blocks.join(F.broadcast(n), "lottery").select("lottery", F.pmod(F.col("ord") - 2 * block, F.col("n")).alias("start"), *sums)  # one row a game
    many = F.expr(f"(n + {block - 1}) div {block}")
    # a game's few rows are dealt to all tasks before its starts, ten times as many as draws at 200 replicates of 20, are made
    r = n.select("lottery", "n", F.explode(F.sequence(F.lit(1), F.lit(B))).alias("replicate"))
    r = r.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"((n + {block - 1}) div {block} - 1) div {PIECE}"))))
    r = r.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lottery", "replicate", "piece")
    r = r.withColumn("j", F.explode(F.sequence(F.col("piece") * PIECE, F.least((F.col("piece") + 1) * PIECE, many) - 1)))
    x = (F.col("replicate").cast("bigint") * 7_919 + F.col("j") * 104_729 + seed * 1_299_709) % _PRIME
    for _ in range(3):
        x = x * _STEP % _PRIME
    starts = r.select("lottery", "replicate", (x % F.col("n")).alias("start")).hint("merge")  # estimated as small, but never to be broadcast
    return starts.join(blocks, ["lottery", "start"]).groupBy("lottery", "replicate").agg(*(F.sum(c).alias(c) for c in sums))


def ratio_interval(series: DataFrame, top: str, bottom: str, block: int, B: int = 200, seed: int = 11) -> DataFrame:
    """(lottery, ratio, se, lo, hi): sum(top) / sum(bottom) with the 95 % interval of its block bootstrap."""
    whole = series.groupBy("lottery").agg((F.sum(top) / F.sum(bottom)).alias("ratio"))
    b = block_bootstrap(series, [top, bottom], block, B, seed).select("lottery", (F.col(top) / F.col(bottom)).alias("x"))
    b = b.groupBy("lottery").agg(F.stddev("x").alias("se"), F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return whole.join(b, "lottery").select("lottery", F.round("ratio", 6).alias("ratio"), F.round("se", 6).alias("se"), F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


def ratio_test(series: DataFrame, p1: float, p2: float, block: int = 20, B: int = 200) -> DataFrame:
    """First winners against those that second winners (``winners2``) imply, with halves and z."""
    d = with_order(series).withColumn("implied", F.col("winners2") * (p1 / p2))
    half = d.join(F.broadcast(d.groupBy("lottery").agg(F.max("ord").alias("n"))), "lottery").withColumn("early", F.col("ord") * 2 <= F.col("n"))  # one row a game
    part = lambda c: F.round(F.sum(F.when(c, F.col("winners1"))) / F.sum(F.when(c, F.col("implied"))), 6)
    halves = half.groupBy("lottery").agg(part(F.col("early")).alias("first_half"), part(~F.col("early")).alias("second_half"))
    ci = ratio_interval(d.drop("ord"), "winners1", "implied", block, B)
    return ci.join(halves, "lottery").withColumn("z", F.round((F.col("ratio") - 1) / F.col("se"), 3))


def ratio_by_year(series: DataFrame, p1: float, p2: float, least: int = 20) -> DataFrame:
    """The ratio of ``ratio_test`` per year of ``least`` draws or more."""
    g = series.groupBy("lottery", "issue_year").agg(F.count(F.lit(1)).alias("draws"), F.sum("winners1").alias("a"), F.sum("winners2").alias("b"))
    return g.where(F.col("draws") >= least).select("lottery", "issue_year", "draws", F.round(F.col("a") / (F.col("b") * (p1 / p2)), 6).alias("ratio"))


def ticket_calibration(series: DataFrame, p2: float, price: float = 2.0, block: int = 20, B: int = 200) -> DataFrame:
    """Tickets by sales against tickets by second winners: factor, interval, and the add-on rate 2 (factor - 1) where it is four errors off 1."""
    d = series.withColumn("by_sales", F.col("sales") / price).withColumn("by_winners", F.col("winners2") / p2)
    f = ratio_interval(d, "by_sales", "by_winners", block, B).withColumnRenamed("ratio", "factor")
    holds = F.abs(F.col("factor") - 1) <= 4 * F.col("se")
    return f.withColumn("holds", holds).withColumn("addon", F.when(holds, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 2 * (F.col("factor") - 1)), 6)))


def award_contrast(series: DataFrame, p1: float, p2: float) -> DataFrame:
    """Draws, and the winner ratio, in award periods (``award``) and otherwise, with their z by Poisson errors."""
    d = series.withColumn("implied", F.col("winners2") * (p1 / p2))
    part = lambda c, what: F.sum(F.when(c, F.col(what)))
    g = d.groupBy("lottery").agg(F.count(F.when(F.col("award"), 1)).alias("awards"), F.count(F.when(~F.col("award"), 1)).alias("others"), *(part(c, w).alias(f"{w}_{n}") for n, c in (("a", F.col("award")), ("o", ~F.col("award"))) for w in ("winners1", "implied")))
    ra, ro = F.col("winners1_a") / F.col("implied_a"), F.col("winners1_o") / F.col("implied_o")
    z = (ra - ro) / F.sqrt(ra * ra / F.col("winners1_a") + ro * ro / F.col("winners1_o"))
    return g.select("lottery", "awards", "others", F.round(ra, 6).alias("in_award"), F.round(ro, 6).alias("otherwise"), F.round(z, 5).alias("z"))


# --- power, edges, pairs ----------------------------------------------------------


def power(counts: DataFrame, size: int, choose: int, delta: float, alpha: float = 0.05) -> DataFrame:
    """(lottery, n, shift, power): chance to see that ``choose`` numbers come ``delta`` more often, for n draws."""
    p0 = choose / size
    a = p0 * (1 + delta)
    b = (choose - choose * a) / (size - choose)
    each = choose * (a - p0) ** 2 / p0 + (size - choose) * (b - p0) ** 2 / p0
    crit = special.chi2_quantile(1 - alpha, size - 1)
    out = counts.select("lottery", "n", F.round(F.col("n") * each, 6).alias("shift"))
    return out.withColumn("power", special.ncx2_sf(F.lit(crit), F.lit(float(size - 1)), F.col("shift")))


def detectable_shift(n: float, size: int, choose: int, target: float = 0.8, alpha: float = 0.05) -> float:
    """The least relative shift that n draws show with chance ``target``."""
    crit, p0 = special.chi2_quantile(1 - alpha, size - 1), choose / size

    def seen(delta: float) -> float:
        a = p0 * (1 + delta)
        b = (choose - choose * a) / (size - choose)
        return special.noncentral_chi2_tail(crit, size - 1, n * (choose * (a - p0) ** 2 / p0 + (size - choose) * (b - p0) ** 2 / p0))

    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if seen(mid) < target else (lo, mid)
    return hi


def bayes_edge(results: DataFrame, prior: float = 0.25) -> DataFrame:
    """(…, mean, se, mu) -> log Bayes factor, chance of an edge, and chance of a positive one; the prior deviation is 1 % of mu."""
    d, s2, t2 = F.col("mean") - F.col("mu"), F.col("se") * F.col("se"), (F.col("mu") * 0.01) * (F.col("mu") * 0.01)
    log = -0.5 * F.ln((s2 + t2) / s2) - 0.5 * d * d / (s2 + t2) + 0.5 * d * d / s2
    bf = F.exp(log)
    edge = bf * prior / (bf * prior + (1 - prior))
    z = (d / s2) / (1 / s2 + 1 / t2) / F.sqrt(1 / (1 / s2 + 1 / t2))
    out = results.select("*", F.round(log, 5).alias("log_bf"), F.round(edge, 6).alias("p_edge"), F.round(z, 6).alias("z_edge"))
    return out.withColumn("p_positive", special.norm_cdf("z_edge") * F.col("p_edge"))


def win_rate_check(settled: DataFrame, rate: float) -> DataFrame:
    """Per strategy: evaluated tickets and winners against ``rate``, z, and a label by the binomial tails (over 20 tickets)."""
    g = settled.where("status = 'evaluated'").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.count("grade").alias("won"))
    out = g.select("strategy", "n", "won", F.round(F.col("won") / F.col("n"), 6).alias("rate"), F.round(F.col("n") * rate, 4).alias("expected"), F.round((F.col("won") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate))), 5).alias("z"))
    tail = F.least(special.binom_cdf(F.col("won").cast("double"), F.col("n").cast("double"), F.lit(rate)), 1 - special.binom_cdf((F.col("won") - 1).cast("double"), F.col("n").cast("double"), F.lit(rate)))
    return out.withColumn("p", tail).withColumn("label", F.when(F.col("n") <= 20, "none").when(F.col("p") < 0.01, "off").when(F.col("p") < 0.05, "drifting").otherwise("agrees"))


def paired_compare(a: DataFrame, b: DataFrame, value: str, target: float = 0.8) -> DataFrame:
    """Two arms on the same draws (lottery, ord, value): mean difference, its deviation, error, z, interval, correlation and the draws needed for power ``target``.

    Games whose draws differ between the arms are not compared (``comparable`` false).
    """
    both = a.select("lottery", "ord", F.col(value).alias("x")).join(b.select("lottery", "ord", F.col(value).alias("y")), ["lottery", "ord"], "full_outer")
    g = both.groupBy("lottery").agg((F.count(F.lit(1)) == F.count(F.col("x") + F.col("y"))).alias("comparable"), F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("d"), F.stddev(F.col("x") - F.col("y")).alias("s"), F.corr("x", "y").alias("r"))
    known = lambda c: F.when(F.col("comparable"), c)
    se = F.col("s") / F.sqrt("n")
    need = special._NORMAL.inv_cdf(0.975) + special._NORMAL.inv_cdf(target)
    out = g.select("lottery", "comparable", "n", known(F.round("d", 6)).alias("difference"), known(F.round("s", 6)).alias("deviation"), known(F.round(F.coalesce(F.try_divide(F.col("d"), se), F.when(F.col("d") == 0, 0.0)), 5)).alias("z"), known(F.round(F.col("d") - 1.959963984540054 * se, 6)).alias("lo"), known(F.round(F.col("d") + 1.959963984540054 * se, 6)).alias("hi"), known(F.round("r", 6)).alias("rho"), known(F.ceil(F.round(F.try_divide(need * need * F.col("s") * F.col("s"), F.col("d") * F.col("d")), 6))).alias("needed"))
    return with_p(out, special.norm_two_sided("z"))
