"""Merging, reconciling and completeness of draws from several sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["lottery", "issue_year", "issue_seq"]
#: Sources from best to worst.
PRIORITY = ("official", "agg", "csv")


def _priority():
    return F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")), F.lit(99))


def best_source(draws: DataFrame) -> DataFrame:
    """Per draw the row of its best source."""
    w = Window.partitionBy(*KEY).orderBy(_priority(), F.col("issue"))
    return draws.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_sources(draws: DataFrame) -> DataFrame:
    """One row per draw: numbers of the best source, missing sales taken from the next best, sources listed."""
    best = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), _priority())).alias(c)
    return draws.groupBy(*KEY).agg(
        best("front"), best("back"), best("sales"), best("first_winners"), F.min("draw_date").alias("draw_date"), F.min_by("source", _priority()).alias("source"), F.countDistinct("source").alias("n_src"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("srcs")
    )


def merge_full(draws: DataFrame, prize_region: DataFrame) -> DataFrame:
    """One row per draw with the fields of all its sources.

    The row of the best source wins, of several the one with the longest issue
    text (then the greatest).  Draw order, sales, pool and first winners that it
    lacks (empty texts are missing) are the greatest that any source has; the
    region text is the greatest of all.  ``n_src`` counts the rows, ``srcs``
    lists their sources, ``region_n`` counts the rows of ``prize_region``
    (lottery, issue) under the winner's issue text.  Rows without a year are
    left out.
    """
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    own = ["issue", "draw_date", "front", "back", "sales", "pool", "first_winners", "source"]
    place = F.struct(-_priority(), F.length("issue"), F.col("issue"))
    g = draws.where("issue_year is not null").groupBy(*KEY).agg(
        F.max_by(F.struct(*own, filled("seq").alias("seq")), place).alias("w"), F.max(filled("seq")).alias("seq"), F.max("sales").alias("sales"), F.max("pool").alias("pool"),
        F.max("first_winners").alias("first_winners"), F.max(filled("region_text")).alias("region_text"), F.count(F.lit(1)).alias("n_src"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("srcs"),
    )
    either = [F.coalesce(F.col(f"w.{c}"), F.col(c)).alias(c) for c in ("seq", "sales", "pool", "first_winners")]
    merged = g.select(*KEY, *(f"w.{c}" for c in ("issue", "draw_date", "front", "back", "source")), *either, "region_text", "n_src", "srcs")
    counts = prize_region.groupBy("lottery", "issue").agg(F.count(F.lit(1)).alias("region_n"))
    return merged.join(counts, ["lottery", "issue"], "left").withColumn("region_n", F.coalesce("region_n", F.lit(0)))


def latest_upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union in which the row with the highest ``order`` of each key wins, new rows before old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def append_new(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming draws after the latest known one of their game that are not there yet."""
    last = local.groupBy("lottery").agg(F.max(F.struct("issue_year", "issue_seq")).alias("last"))
    fresh = incoming.join(last, "lottery", "left").where(F.col("last").isNull() | (F.struct("issue_year", "issue_seq") > F.col("last"))).drop("last")
    return fresh.join(local.select(*KEY), KEY, "left_anti")


def reconcile(draws: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per game of agreeing, conflicting and one-sided-zero fields of two sources."""
    side = lambda s, p: draws.where(F.col("source") == s).select(*KEY, F.array_sort("front").alias(f"{p}front"), F.col("sales").alias(f"{p}sales"))
    both = side(a, "a").join(side(b, "b"), KEY, "full_outer")
    paired = F.col("afront").isNotNull() & F.col("bfront").isNotNull()
    known = paired & F.col("asales").isNotNull() & F.col("bsales").isNotNull()
    zero = known & ((F.col("asales") == 0) != (F.col("bsales") == 0))
    close = known & ~zero & (F.abs(F.col("asales") - F.col("bsales")) <= 1)
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy("lottery").agg(
        n(paired).alias("paired"), n(paired & (F.col("afront") == F.col("bfront"))).alias("numbers_agree"), n(close).alias("sales_agree"), n(known & ~zero & ~close).alias("sales_conflict"), n(zero).alias("zero_side"),
        n(F.col("bfront").isNull()).alias("only_a"), n(F.col("afront").isNull()).alias("only_b"),
    )


def reconcile_fields(draws: DataFrame, a: str, b: str, arrays: tuple[str, ...] = ("front", "back"), money: tuple[str, ...] = ("sales",)) -> DataFrame:
    """(lottery, field, checked, agree, conflict, zero_side, skipped) of two sources, a row a field.

    A field that one side lacks is skipped; money agrees within 1, and a single
    zero is a placeholder, not a conflict.
    """
    fields = [*arrays, *money]
    side = lambda s, p: draws.where(F.col("source") == s).select(*KEY, *((F.array_sort(f) if f in arrays else F.col(f)).alias(f"{p}{f}") for f in fields))
    both = side(a, "a").join(side(b, "b"), KEY)

    def state(f: str):
        x, y = F.col(f"a{f}"), F.col(f"b{f}")
        missing = x.isNull() | y.isNull()
        if f in arrays:
            return F.when(missing, "skipped").when(x == y, "agree").otherwise("conflict")
        return F.when(missing, "skipped").when((x == 0) != (y == 0), "zero_side").when(F.abs(x - y) <= 1, "agree").otherwise("conflict")

    rows = both.select("lottery", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), state(f).alias("state")) for f in fields))).alias("x"))
    n = lambda s: F.count(F.when(F.col("x.state") == s, 1)).alias(s)
    return rows.groupBy("lottery", "x.field").agg(F.count(F.when(F.col("x.state") != "skipped", 1)).alias("checked"), n("agree"), n("conflict"), n("zero_side"), n("skipped"))


def draw_gaps(draws: DataFrame) -> DataFrame:
    """Jumps of more than one in the numbering within a year."""
    w = Window.partitionBy("lottery", "issue_year").orderBy("issue_seq")
    gaps = draws.withColumn("prev_seq", F.lag("issue_seq").over(w)).where("issue_seq - prev_seq > 1")
    return gaps.select("lottery", "issue_year", "prev_seq", "issue_seq", (F.col("issue_seq") - F.col("prev_seq") - 1).alias("missing"))


def missing_issues(draws: DataFrame) -> DataFrame:
    """Every number missing between a year's own first and last."""
    span = draws.groupBy("lottery", "issue_year").agg(F.min("issue_seq").alias("lo"), F.max("issue_seq").alias("hi"))
    every = span.select("lottery", "issue_year", F.explode(F.sequence("lo", "hi")).alias("issue_seq"))
    return every.join(draws.select(*KEY), KEY, "left_anti")


def duplicate_draws(draws: DataFrame) -> DataFrame:
    """Number combinations drawn more than once."""
    return draws.groupBy("lottery", F.array_join(F.array_sort("front"), "-").alias("numbers")).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def duplicate_excess(draws: DataFrame, universe: int) -> DataFrame:
    """Per game: draws that repeat an earlier combination, against the birthday baseline n (n - 1) / (2 universe), as z."""
    g = draws.groupBy("lottery", F.array_sort("front").alias("f")).agg(F.count(F.lit(1)).alias("c")).groupBy("lottery").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("repeats"))
    expected = F.col("n") * (F.col("n") - 1) / (2.0 * universe)
    return g.select("lottery", "n", "repeats", F.round(expected, 6).alias("expected"), F.round((F.col("repeats") - expected) / F.sqrt(expected), 6).alias("z"))


def duplicate_issues(draws: DataFrame) -> DataFrame:
    """Issue numbers that a source has more than once."""
    return draws.groupBy("lottery", "source", "issue").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def date_gaps(draws: DataFrame, days: int) -> DataFrame:
    """Per game: longest distance between draws, how many exceed ``days``, draws on a day already used.

    Only the days that have draws are put in order, not the draws.
    """
    per = draws.groupBy("lottery", "draw_date").agg((F.count(F.lit(1)) - 1).alias("again"))
    w = Window.partitionBy("lottery").orderBy("draw_date")  # one row a day
    d = per.withColumn("apart", F.datediff("draw_date", F.lag("draw_date").over(w)))
    longest = F.greatest(F.max("apart"), F.when(F.sum("again") > 0, F.lit(0))).cast("bigint")
    return d.groupBy("lottery").agg(longest.alias("longest"), F.count(F.when(F.col("apart") > days, 1)).alias("over"), F.sum("again").alias("same_day"))


def source_coverage(draws: DataFrame) -> DataFrame:
    """Per game and source: draws, first and last day, how many have sales and how many a draw order other than the sorted one."""
    ordered = F.col("front") != F.array_sort("front")
    return draws.groupBy("lottery", "source").agg(F.count(F.lit(1)).alias("draws"), F.min("draw_date").alias("first_date"), F.max("draw_date").alias("last_date"), F.count("sales").alias("with_sales"), F.count(F.when(ordered, 1)).alias("with_order"))


def draw_search(draws: DataFrame, size: int, page: int = 1, lotteries=None, sources=None, dates=None, sales=None, winners=None, numbers=(), bonus=(), text: str = "", by: str = "sales") -> DataFrame:
    """One page of the draws that meet all filters, best ``by`` first with nulls last, with their places and the total.

    Filters: games, any of the sources (in ``srcs``), a range of days, of sales
    in units of 10,000 and of first winners, numbers that must all be drawn, and
    a text within issue number or day.  The page is a distributed top-n.
    """
    found = draws
    if lotteries:
        found = found.where(F.col("lottery").isin(*lotteries))
    if sources:
        found = found.where(F.arrays_overlap(F.split("srcs", ","), F.array(*map(F.lit, sources))))
    if dates:
        found = found.where(F.col("draw_date").between(*map(F.lit, dates)))
    if sales:
        found = found.where(F.col("sales").between(*(x * 10_000 for x in sales)))
    if winners:
        found = found.where(F.col("first_winners").between(*winners))
    for column, wanted in (("front", numbers), ("back", bonus)):
        for x in wanted:
            found = found.where(F.array_contains(column, x))
    if text:
        seq = F.col("issue_seq").cast("string")
        issue = F.concat(F.col("issue_year").cast("string"), F.lpad(seq, F.greatest(F.length(seq), F.lit(5)), "0"))
        found = found.where(issue.contains(text) | F.col("draw_date").cast("string").contains(text))
    order = [F.col(by).desc_nulls_last(), *KEY]
    total = found.agg(F.count(F.lit(1)).alias("total"))
    top = found.orderBy(*order).limit(page * size)
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")  # page * size rows
    paged = top.select(*KEY, "sales", place.alias("place")).where(F.col("place") > (page - 1) * size)
    return paged.crossJoin(F.broadcast(total))  # one row
