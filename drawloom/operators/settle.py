"""Tickets against draws: hits, grades, money, ledgers and leaderboards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number_mask, tax, zone_hits
from .order import by, rank_by_parts, stretched

#: Grades of the 6-of-33 and 1-of-16 game by (main hits, bonus hits), with the prize per bet.
GRADES = ((6, 1, 1, 5_000_000), (6, 0, 2, 200_000), (5, 1, 3, 3_000), (5, 0, 4, 200), (4, 1, 4, 200), (4, 0, 5, 10), (3, 1, 5, 10), (2, 1, 6, 5), (1, 1, 6, 5), (0, 1, 6, 5))
PRICE = 2
F_DESC, F_ASC = "desc", "asc"


def rules(spark) -> DataFrame:
    return spark.createDataFrame(GRADES, "h int, j int, grade int, amount long")


def with_draw(tickets: DataFrame, draws: DataFrame) -> DataFrame:
    """``tickets`` with the columns of ``draws`` for the draw they name (``draw_k``), null if they name none or there is none.

    Tickets that name no draw are dealt by their own id; as nulls they would all come into one task.
    """
    key = F.coalesce(F.col("draw_k"), F.col("ticket_id"))
    named = draws.withColumnRenamed("draw_k", "_k")
    return tickets.join(named, (key == F.col("_k")) & F.col("draw_k").isNotNull(), "left").drop("_k")


def settle(tickets: DataFrame, draws: DataFrame, late_days: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every ticket with the draw it names: hits per zone, grade, amount, status, and the columns ``keep`` of the ticket or the draw.

    A ticket without its draw is pending, or missed once ``late_days`` old
    against the latest draw.
    """
    spark = tickets.sparkSession
    won = draws.select(F.col("k").alias("draw_k"), "lottery", "draw_date", number_mask(F.col("front")).alias("dm"), number_mask(F.col("back")).alias("db"), *(c for c in keep if c in draws.columns))
    t = tickets.withColumn("tm", number_mask(F.col("main"))).withColumn("tb", number_mask(F.col("bonus")))
    hit = with_draw(t, won).withColumn("h", zone_hits(F.col("tm"), F.col("dm"))).withColumn("j", zone_hits(F.col("tb"), F.col("db")))
    graded = hit.join(F.broadcast(rules(spark)), ["h", "j"], "left")
    amount = F.when(F.col("dm").isNotNull(), F.coalesce("amount", F.lit(0)))
    latest = draws.agg(F.max("draw_date").alias("latest")).withColumn("one", F.lit(1))
    status = F.when(F.col("dm").isNotNull(), "evaluated").when(F.datediff("latest", F.to_date("generated")) > late_days, "missed").otherwise("pending")
    return graded.withColumn("one", F.lit(1)).join(F.broadcast(latest), "one").select("ticket_id", "batch", "lottery", "draw_k", "strategy", "tier", "score", "h", "j", "grade", amount.cast("bigint").alias("amount"), status.alias("status"), "draw_date", *keep)


def ledger(settled: DataFrame) -> DataFrame:
    """Per draw taken part in: tickets, cost, gross, tax (of the issue's sum), net, running total, peak, drawdown, worst drawdown so far, draws since the peak and the most of them so far."""
    per = settled.where("status = 'evaluated'").groupBy("lottery", "draw_date", "draw_k").agg(F.count(F.lit(1)).alias("tickets"), F.sum("amount").cast("double").alias("gross"), F.count("grade").alias("wins"))
    per = per.withColumn("cost", (F.col("tickets") * PRICE).cast("double")).withColumn("tax", tax(F.col("gross"))).withColumn("net", F.col("gross") - F.col("tax") - F.col("cost"))
    return drawdown(rank_by_parts(per, ["lottery"], F.col("draw_date"), ["draw_date", "draw_k"], "ord"))


def drawdown(series: DataFrame) -> DataFrame:
    """Running total of ``net`` by ``ord`` within a game, with peak (0 at least), drawdown, its worst, the draws ``under`` the last peak and the most of them.

    A stretch of draws is summed up by itself into one row (total, highest and
    lowest point, deepest fall, its record points); windows over these rows tell
    what each stretch takes along, which is joined back once.
    """
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    d = stretched(series).drop("lead").withColumn("_at", F.round(F.sum("net").over(upto), 4)).withColumn("_top", F.max("_at").over(upto))
    record = F.when(F.col("_at") == F.col("_top"), F.struct("ord", "_at"))
    own = [F.max_by("_at", "ord").alias("total"), F.max("_at").alias("high"), F.min("_at").alias("low"), F.max(F.col("_top") - F.col("_at")).alias("fall"), F.max("ord").alias("end"), F.array_sort(F.collect_list(record)).alias("records")]
    earlier = Window.partitionBy("lottery").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    s = d.groupBy("lottery", "stretch").agg(*own).withColumn("_net", F.coalesce(F.round(F.sum("total").over(earlier), 4), F.lit(0.0)))
    s = s.withColumn("_peak", F.greatest(F.lit(0.0), F.max(F.round(F.col("_net") + F.col("high"), 4)).over(earlier)))
    # the records that reach the peak so far, by draw
    s = s.withColumn("peaks", F.transform(F.filter("records", lambda r: F.round(F.col("_net") + r["_at"], 4) >= F.col("_peak")), lambda r: r["ord"]))
    s = s.withColumn("_last", F.coalesce(F.max(F.array_max("peaks")).over(earlier), F.lit(0)))
    ends = F.concat(F.array("_last"), F.col("peaks"))
    gaps = F.zip_with(ends, F.concat(F.col("peaks"), F.array(F.col("end") + 1)), lambda x, y: y - x - 1)
    s = s.withColumn("_worst", F.max(F.greatest(F.col("_peak") - F.col("_net") - F.col("low"), F.col("fall"))).over(earlier)).withColumn("_under", F.max(F.array_max(gaps)).over(earlier))
    d = d.join(s.select("lottery", "stretch", "_net", "_peak", "_last", "_worst", "_under"), ["lottery", "stretch"])
    d = d.withColumn("running", F.round(F.col("_net") + F.col("_at"), 4)).withColumn("peak", F.greatest("_peak", F.round(F.col("_net") + F.col("_top"), 4)))
    d = d.withColumn("drawdown", F.round(F.col("peak") - F.col("running"), 4)).withColumn("worst", F.greatest(F.max("drawdown").over(upto), F.round("_worst", 4)))
    d = d.withColumn("under", F.col("ord") - F.greatest(F.max(F.when(F.col("drawdown") == 0, F.col("ord"))).over(upto), "_last"))
    d = d.withColumn("longest_under", F.greatest(F.max("under").over(upto), "_under"))
    return d.drop("_at", "_top", "_net", "_peak", "_last", "_worst", "_under", "stretch", "ord")


def leaderboard(settled: DataFrame) -> DataFrame:
    """Per strategy: tickets, mean hits, wins and their rate."""
    g = settled.where("status = 'evaluated'").groupBy("strategy").agg(F.count(F.lit(1)).alias("tickets"), F.round(F.avg("h"), 6).alias("mean_main"), F.round(F.avg("j"), 6).alias("mean_bonus"), F.count("grade").alias("wins"))
    return g.withColumn("rate", F.round(F.col("wins") / F.col("tickets"), 6))


def attribution(settled: DataFrame) -> DataFrame:
    """Tickets, wins and prizes by strategy and tier, with totals."""
    return settled.where("status = 'evaluated'").cube("strategy", "tier").agg(F.count(F.lit(1)).alias("tickets"), F.count("grade").alias("wins"), F.sum("amount").alias("prizes"), F.count(F.when(F.col("grade") <= 5, 1)).alias("ten_or_more"))


#: Columns of the zones whose hits can be asked for.
ZONES = {"main": "h", "bonus": "j"}
#: Sort keys of the search.
SORTS = {"amount": F_DESC, "hits": F_DESC, "date": F_DESC, "grade": F_ASC, "score": F_DESC, "ticket": F_ASC}


def hit_filter(least: dict[str, int] | None = None, lotteries=None, strategies=None, dates=None, best_grade: int | None = None, least_amount: int | None = None) -> Column:
    """Winners that meet all conditions; hits are asked for by zone, and a zone that is none is an error."""
    unknown = set(least or ()) - set(ZONES)
    if unknown:
        raise ValueError(f"no such zone: {sorted(unknown)}")
    ok = F.col("grade").isNotNull()
    for zone, n in (least or {}).items():
        ok = ok & (F.col(ZONES[zone]) >= n)
    if lotteries:
        ok = ok & F.col("lottery").isin(*lotteries)
    if strategies:
        ok = ok & F.col("strategy").isin(*strategies)
    if dates:
        ok = ok & F.col("draw_date").between(*map(F.lit, dates))
    if best_grade:
        ok = ok & (F.col("grade") <= best_grade)
    if least_amount:
        ok = ok & (F.col("amount") >= least_amount)
    return ok


def search_hits(settled: DataFrame, ok: Column, top: int, by: str = "amount") -> DataFrame:
    """The ``top`` winning tickets that ``ok`` (``hit_filter``) lets through, by a key of SORTS, then amount, hits and id."""
    columns = {"amount": "amount", "hits": "h", "date": "draw_date", "grade": "grade", "score": "score", "ticket": "ticket_id"}
    first = F.col(columns[by]).desc() if SORTS[by] == F_DESC else F.col(columns[by]).asc()
    found = settled.where(ok).orderBy(first, F.col("amount").desc(), F.col("h").desc(), "ticket_id").limit(top)
    return found.select("ticket_id", "h", "j", "grade", "amount")


def search_totals(settled: DataFrame, ok: Column) -> DataFrame:
    """Evaluated tickets, winners, and those that match, with their money and how many amounts are unknown."""
    d = settled.where("status = 'evaluated'")
    match = F.coalesce(ok, F.lit(False))
    return d.agg(F.count(F.lit(1)).alias("tickets"), F.count("grade").alias("winners"), F.count(F.when(match, 1)).alias("matched"), F.coalesce(F.sum(F.when(match, F.col("amount"))), F.lit(0)).alias("money"), F.count(F.when(F.col("grade").isNotNull() & F.col("amount").isNull(), 1)).alias("unknown"))


def _subsets(numbers: Column) -> Column:
    """Masks of all subsets of an array of up to 16 numbers."""
    bit = lambda x, on: F.when(on, F.call_function("shiftleft", F.lit(1).cast("bigint"), x.cast("int"))).otherwise(F.lit(0).cast("bigint"))
    one = lambda s: F.aggregate(F.transform(numbers, lambda x, i: bit(x, F.call_function("getbit", s.cast("bigint"), i.cast("int")) == 1)), F.lit(0).cast("bigint"), lambda a, m: a + m)
    return F.transform(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size(numbers)) - 1), one)


def replay(tickets: DataFrame, draws: DataFrame, least_grade: int, choose: int = 6) -> DataFrame:
    """All tickets against every draw: per draw best main hits, winners, money, and whether a grade of ``least_grade`` or better came.

    No ticket meets a draw as a pair.  Tickets are counted by the subsets of
    their numbers; from the counts of a draw's own subsets of s numbers, summed,
    follow by inclusion and exclusion the tickets with exactly h hits.
    """
    t = tickets.groupBy(F.array_sort("main").alias("main"), F.element_at("bonus", 1).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = t.withColumn("m", F.explode(_subsets(F.col("main")))).groupBy("m", "b").agg(F.sum("n").alias("n"))
    kinds = draws.select(F.array_sort("front").alias("front"), F.element_at("back", 1).alias("back")).distinct()
    own = kinds.withColumn("m", F.explode(_subsets(F.col("front"))))
    found = own.join(counts, "m").withColumn("s", F.bit_count("m"))
    sums = [F.sum(F.when((F.col("s") == s) & (F.col("b") == F.col("back") if j else F.lit(True)), F.col("n")).otherwise(0)).alias(f"e{s}_{j}") for s in range(choose + 1) for j in (0, 1)]
    g = found.groupBy("front", "back").agg(*sums)
    exactly = lambda h, j: sum((F.col(f"e{s}_{j}") * ((-1) ** (s - h) * math.comb(s, h)) for s in range(h, choose + 1)), F.lit(0))
    g = g.select("front", "back", *(exactly(h, j).alias(f"n{h}_{j}") for h in range(choose + 1) for j in (0, 1)))
    with_bonus = {(h, j): F.col(f"n{h}_1") if j else F.col(f"n{h}_0") - F.col(f"n{h}_1") for h in range(choose + 1) for j in (0, 1)}
    best = F.greatest(*(F.when(F.col(f"n{h}_0") > 0, h).otherwise(0) for h in range(choose + 1)))
    total = lambda value: sum((with_bonus[h, j] * value(grade, amount) for h, j, grade, amount in GRADES), F.lit(0))
    g = g.select("front", "back", best.cast("bigint").alias("best"), total(lambda g_, a: 1).alias("winners"), total(lambda g_, a: a).alias("money"), (total(lambda g_, a: int(g_ <= least_grade)) > 0).alias("reached"))
    d = draws.select("lottery", "issue_year", "issue_seq", F.array_sort("front").alias("front"), F.element_at("back", 1).alias("back"))
    return d.join(g, ["front", "back"], "left").select("lottery", "issue_year", "issue_seq", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("winners", F.lit(0)).cast("bigint").alias("winners"), F.coalesce("money", F.lit(0)).cast("bigint").alias("money"), F.coalesce("reached", F.lit(False)).alias("reached"))


def batches(settled: DataFrame, gap_seconds: int, time: str) -> DataFrame:
    """Sessions of rows of a key that follow each other within the gap."""
    w = Window.partitionBy("key").orderBy(time, "id")
    start = F.coalesce((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    d = settled.withColumn("_start", start).withColumn("batch", F.sum("_start").over(w))
    return d.groupBy("key", "batch").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def numbered_batches(rows: DataFrame, gap_seconds: int = 5) -> DataFrame:
    """(lottery, issue, batch_id, kind, n, first, last, place, of): the batches in which tickets were made, numbered within their issue.

    ``rows`` has lottery, issue, batch_id and time.  Rows with an id form its
    batch ("explicit"), under the issue of its earliest row, of equals the
    least; the others of an issue follow each other until more than
    ``gap_seconds`` pass ("derived", named D:lottery:issue:number), rows
    without a time joining the last.  ``place`` (of ``of``) counts both kinds of
    an issue by first time, then id; batches without a time come first.  Rows
    of one time are counted before an issue's times meet in a task.
    """
    t = rows.select("lottery", "issue", "batch_id", F.col("time").cast("timestamp").alias("time"))
    many = F.count(F.lit(1)).alias("n")
    named = t.where("batch_id is not null and batch_id <> ''").groupBy("lottery", "batch_id", "issue", "time").agg(many).groupBy("lottery", "batch_id")
    named = named.agg(F.min(F.struct(F.col("time").isNull().alias("late"), "time", "issue"))["issue"].alias("issue"), F.sum("n").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    w = Window.partitionBy("lottery", "issue").orderBy(F.col("time").asc_nulls_last())
    apart = F.unix_micros("time") - F.unix_micros(F.lag("time").over(w)) > gap_seconds * 1_000_000
    times = t.where("batch_id is null or batch_id = ''").groupBy("lottery", "issue", "time").agg(many)
    times = times.withColumn("new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(apart, F.lit(False)).cast("int"))).withColumn("seq", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    derived = times.groupBy("lottery", "issue", "seq").agg(F.sum("n").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))
    label = F.concat_ws(":", F.lit("D"), "lottery", F.col("issue").cast("string"), F.col("seq").cast("string"))
    columns = ["lottery", "issue", "batch_id", "kind", "n", "first", "last"]
    both = named.withColumn("kind", F.lit("explicit")).select(*columns).unionByName(derived.withColumn("batch_id", label).withColumn("kind", F.lit("derived")).select(*columns))
    issue = Window.partitionBy("lottery", "issue")  # one row a batch
    return both.withColumn("place", F.row_number().over(issue.orderBy(F.col("first").asc_nulls_first(), "batch_id")).cast("bigint")).withColumn("of", F.count(F.lit(1)).over(issue))


def overlap(tickets: DataFrame, size: int = 33, choose: int = 6, cap: int = 2) -> DataFrame:
    """Common numbers of the pairs within a batch (batches are small): mean, most, the mean of random tickets, share of pairs over ``cap``, and how many independent tickets the batch is worth (n / (1 + (n - 1) mean / choose))."""
    t = tickets.select("batch", "ticket_id", number_mask(F.col("main")).alias("m"))
    u = t.select("batch", F.col("ticket_id").alias("other"), F.col("m").alias("om"))
    pairs = t.join(u, "batch").where("ticket_id < other").withColumn("x", zone_hits(F.col("m"), F.col("om")))
    g = pairs.groupBy("batch").agg(F.count(F.lit(1)).alias("pairs"), F.avg("x").alias("_m"), F.max("x").cast("bigint").alias("max_overlap"), F.round(F.avg((F.col("x") > cap).cast("int")), 6).alias("clashing"))
    n = (1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2
    return g.select("batch", "pairs", F.round("_m", 6).alias("mean_overlap"), "max_overlap", F.lit(round(choose * choose / size, 6)).alias("random_overlap"), "clashing", F.round(n / (1 + (n - 1) * F.col("_m") / choose), 6).alias("effective"))
