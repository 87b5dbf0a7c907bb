"""Winners and sales by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_non_region_buckets, parse_region_text, parse_total, region_name


def region_board(regions: DataFrame, top: int) -> DataFrame:
    """Per game the regions with most winners."""
    g = regions.groupBy("lottery", "region").agg(F.sum("winners").alias("winners"), F.count(F.lit(1)).alias("draws"))
    w = Window.partitionBy("lottery").orderBy(F.col("winners").desc(), "region")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).withColumn("per_draw", F.round(F.col("winners") / F.col("draws"), 6))


def region_shares(regions: DataFrame) -> DataFrame:
    """Each region's share of sales against its share of winners."""
    g = regions.groupBy("region").agg(F.sum("sales").alias("sales"), F.sum("winners").alias("winners"))
    everything = Window.partitionBy()  # one row a region
    share = lambda c: F.round(F.col(c) / F.sum(c).over(everything), 9)
    return g.select("region", "sales", "winners", share("sales").alias("sales_share"), share("winners").alias("winner_share"))


def region_year_trend(regions: DataFrame) -> DataFrame:
    """Winners and draws of every region by year and game, in rows (a pivot of them takes the games as they come)."""
    return regions.groupBy("region", "issue_year", "lottery").agg(F.sum("winners").alias("winners"), F.count(F.lit(1)).alias("draws"))


def pivot_games(trend: DataFrame, games: list[str] | None = None) -> DataFrame:
    """``region_year_trend`` with a column of winners a game; without ``games``, of those that there are."""
    return trend.groupBy("region", "issue_year").pivot("lottery", games).agg(F.sum("winners")).fillna(0)


def latest_regions(texts: DataFrame, n: int) -> DataFrame:
    """Per game the last ``n`` draws with a region text."""
    w = Window.partitionBy("lottery").orderBy(F.col("issue_year").desc(), F.col("issue_seq").desc())
    found = texts.where(F.trim("region_text") != "").withColumn("place", F.row_number().over(w).cast("bigint"))
    return found.where(F.col("place") <= n).select("lottery", "place", "issue_year", "issue_seq", "region_text")


def region_sales_monthly(sales: DataFrame, agencies: list[str] | None = None) -> DataFrame:
    """Sales by month with a column an agency and the total; without ``agencies``, of those that there are."""
    g = sales.groupBy("ym").pivot("agency", agencies).agg(F.sum("sales")).fillna(0)
    columns = [c for c in g.columns if c != "ym"]
    return g.select("ym", *(F.round(c, 2).alias(c) for c in columns), F.round(sum((F.col(c) for c in columns), F.lit(0)), 2).alias("total"))


def region_sales_summary(sales: DataFrame, top: int = 5) -> DataFrame:
    """Per agency: months, first and last, growth from first to last month, best and worst regions."""
    months = sales.groupBy("agency", "ym").agg(F.sum("sales").alias("s"))
    g = months.groupBy("agency").agg(F.count(F.lit(1)).alias("months"), F.min("ym").alias("first"), F.max("ym").alias("last"), (F.max_by("s", "ym") / F.min_by("s", "ym") - 1).alias("growth"))
    regions = sales.groupBy("agency", "region").agg(F.sum("sales").alias("s"))
    ranked = lambda sign: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((F.round("s", 2) * sign).alias("s"), "region"))), 1, top), lambda x: x["region"]), ",")  # one row a region
    ends = regions.groupBy("agency").agg(F.count(F.lit(1)).alias("regions"), ranked(-1).alias("best"), ranked(1).alias("worst"))
    return g.join(ends, "agency").select("agency", "months", "first", "last", F.round("growth", 6).alias("growth"), "regions", "best", "worst")


def missing_months(sales: DataFrame) -> DataFrame:
    """Per agency the months between its first and last without sales."""
    day = lambda c: F.to_date(c, "yyyyMM")
    span = sales.groupBy("agency").agg(F.min("ym").alias("lo"), F.max("ym").alias("hi"))
    every = span.select("agency", F.explode(F.sequence(day("lo"), day("hi"), F.expr("interval 1 month"))).alias("m")).select("agency", F.date_format("m", "yyyyMM").alias("ym"))
    return every.join(sales.select("agency", "ym").distinct(), ["agency", "ym"], "left_anti")


def read_region_sales(rows: DataFrame) -> DataFrame:
    """Long regional sales with ``ym`` as YYYYMM, regions under their usual names and amounts as numbers."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), "[,，%]", "").try_cast("double").alias(c)
    ym = F.regexp_replace(F.trim(F.col("ym").cast("string")), "[^0-9]", "")
    return rows.select(ym.alias("ym"), region_name(F.regexp_replace("region", r"[\s　]+", "")).alias("region"), F.trim("agency").alias("agency"), number("sales_wan"), number("yoy"), number("cumulative_wan"))


def first_winner_reference(prizes: DataFrame) -> DataFrame:
    """(lottery, k, reference): the most first-prize winners that any source states."""
    return prizes.where((F.col("level") == 1) & F.col("winners").isNotNull()).groupBy("lottery", "k").agg(F.max("winners").alias("reference"))


def region_check(regions: DataFrame, prizes: DataFrame, texts: DataFrame) -> DataFrame:
    """(lottery, k, regional, reference, multi, verdict) of every draw with regional rows (lottery, k, source, region, winners).

    ok: the regional sum is the reference; ok_explained: with the winners of no
    region it is; src_conflict: it is what the text itself states; else low or
    high; noref without a reference.  ``multi`` says that several sources added.
    """
    per = regions.groupBy("lottery", "k").agg(F.sum("winners").alias("regional"), (F.countDistinct("source") > 1).alias("multi"))
    said = texts.select("lottery", "k", parse_total(F.col("region_text")).alias("stated"), parse_non_region_buckets(F.col("region_text")).alias("bucket"))
    d = per.join(first_winner_reference(prizes), ["lottery", "k"], "left").join(said, ["lottery", "k"], "left")
    s, r = F.col("regional"), F.col("reference")
    verdict = (
        F.when(r.isNull(), "noref").when(s == r, "ok").when((F.coalesce("bucket", F.lit(0)) > 0) & (s + F.col("bucket") == r), "ok_explained").when(s == F.col("stated"), "src_conflict").when(s < r, "low").otherwise("high")
    )
    return d.select("lottery", "k", "regional", "reference", "multi", verdict.alias("verdict"))


def region_check_report(checked: DataFrame) -> DataFrame:
    """Counts and sums of ``region_check`` by game and verdict."""
    return checked.groupBy("lottery", "verdict").agg(F.count(F.lit(1)).alias("issues"), F.count(F.when(F.col("multi"), 1)).alias("multi"), F.sum("regional").alias("regional"), F.sum("reference").alias("reference"))


def pending_regions(draws: DataFrame, regions: DataFrame, probed: DataFrame, prizes: DataFrame) -> DataFrame:
    """(lottery, k, state) of every draw: filled, probed, no_winner (a known zero), or pending; an unknown count keeps a draw pending."""
    mark = lambda df, name: df.select("lottery", "k").distinct().withColumn(name, F.lit(True))
    d = draws.select("lottery", "k").join(mark(regions, "filled"), ["lottery", "k"], "left").join(mark(probed, "probed"), ["lottery", "k"], "left").join(first_winner_reference(prizes), ["lottery", "k"], "left")
    state = F.when(F.col("filled"), "filled").when(F.col("probed"), "probed").when(F.col("reference") == 0, "no_winner").otherwise("pending")
    return d.select("lottery", "k", state.alias("state"))


def reparse_regions(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """(lottery, k, state, delta) of every draw with a text: what reading it again would do to its regional rows.

    ambiguous: several sources; unparsed: nothing is read; new: no rows yet;
    else changed or unchanged.  ``delta`` is the change of winners.
    """
    old = regions.groupBy("lottery", "k").agg(F.countDistinct("source").alias("sources"), F.array_sort(F.collect_list(F.struct("region", F.col("winners").cast("int").alias("winners")))).alias("old"), F.sum("winners").alias("had"))  # a draw's regions
    new = texts.where(F.trim("region_text") != "").select("lottery", "k", F.array_sort(parse_region_text(F.col("region_text"))).alias("new"))
    d = new.join(old, ["lottery", "k"], "left").withColumn("has", F.aggregate("new", F.lit(0), lambda a, r: a + r["winners"]))
    state = F.when(F.col("sources") > 1, "ambiguous").when(F.size("new") == 0, "unparsed").when(F.col("old").isNull(), "new").when(F.to_json("new") == F.to_json("old"), "unchanged").otherwise("changed")
    delta = F.when(state.isin("changed", "new"), F.col("has") - F.coalesce("had", F.lit(0))).otherwise(0)
    return d.select("lottery", "k", state.alias("state"), delta.cast("bigint").alias("delta"))


def return_rate(series: DataFrame) -> DataFrame:
    """Per game: share of sales paid for the first two prizes over all draws, and its mean, least and most per draw, in percent."""
    paid = F.col("winners1") * F.col("prize1") + F.col("winners2") * F.col("prize2")
    d = series.where(F.col("sales") > 0).select("lottery", "sales", paid.alias("paid"), (paid / F.col("sales")).alias("r"))
    return d.groupBy("lottery").agg(F.count(F.lit(1)).alias("draws"), F.round(F.sum("paid") / F.sum("sales") * 100, 4).alias("weighted"), F.round(F.avg("r") * 100, 4).alias("mean"), F.round(F.min("r") * 100, 4).alias("least"), F.round(F.max("r") * 100, 4).alias("most"))


def first_ball(series: DataFrame) -> DataFrame:
    """How often each number was drawn first."""
    return series.groupBy("lottery", F.element_at("seq", 1).alias("num")).agg(F.count(F.lit(1)).alias("times"))


def position_stats(series: DataFrame) -> DataFrame:
    """Count, mean, least and largest number at each place of the draw order."""
    d = series.select("lottery", F.posexplode("seq").alias("pos", "x"))
    return d.groupBy("lottery", "pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"))


def approx_profiles(draws: DataFrame, error: float = 0.02) -> DataFrame:
    """Per game: about how many different combinations (relative error ``error``) and about the deciles of sales."""
    return draws.groupBy("lottery").agg(F.approx_count_distinct(F.array_join("front", "-"), error).alias("combinations"), F.percentile_approx("sales", [i / 10 for i in range(1, 10)], 10_000).alias("deciles"))
