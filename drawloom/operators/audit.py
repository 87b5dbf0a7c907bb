"""Cleaning raw draws, validating tickets, recomputing feedback, and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import is_valid_prediction, number_mask, to_int_money, zone_hits
from .completeness import number_errors
from .draw_stats import adjacent_repeat, bh_adjust, frequency, draw_numbers, runs_test, uniformity
from .settle import rules, with_draw


def clean_draws(raw: DataFrame, main: list[str], bonus: list[str], main_range: tuple[int, int], bonus_range: tuple[int, int]) -> DataFrame:
    """Raw text rows (issue, number columns, sales) with typed numbers and the ``reason`` why a row does not count; null for good rows.

    ``#`` and blanks are no numbers (sales: 0).  The first fault in the order
    issue, main numbers, main repeats, bonus numbers, bonus repeats is named.
    """
    number = lambda c: F.regexp_replace(F.trim(c), "[,，]", "").try_cast("double").cast("int")
    a, b = F.array(*map(number, main)), F.array(*map(number, bonus))
    bad = lambda x, r: F.exists(x, lambda v: v.isNull()) | F.exists(x, lambda v: ~v.between(*r))
    d = raw.withColumns({"_issue": number("issue"), "front": a, "back": b})
    reason = (
        F.when(F.col("_issue").isNull(), "issue").when(F.exists("front", lambda v: v.isNull()), "main_invalid").when(bad(F.col("front"), main_range), "main_range").when(F.size(F.array_distinct("front")) < len(main), "main_repeat")
        .when(F.exists("back", lambda v: v.isNull()), "bonus_invalid").when(bad(F.col("back"), bonus_range), "bonus_range").when(F.size(F.array_distinct("back")) < len(bonus), "bonus_repeat")
    )
    return d.select("k", F.col("_issue").alias("issue"), "front", "back", F.coalesce(to_int_money(F.regexp_replace("sales", "#", "")), F.lit(0)).alias("sales"), reason.alias("reason"))


def clean_report(cleaned: DataFrame) -> DataFrame:
    """Rows by reason; ``kept`` for those without."""
    return cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validate_tickets(tickets: DataFrame, draws: DataFrame, size: int, high: int, bonus_high: int) -> DataFrame:
    """(ticket_id, problems) of tickets with any: main or bonus count, range and repeat; a copy within the batch; a batch that is not as large as declared; a target drawn before the ticket was made."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("batch", "_key"))
    actual = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    days = draws.select(F.col("k").alias("draw_k"), "draw_date")
    d = tickets.withColumn("_key", F.concat_ws("|", F.array_join(F.array_sort("main"), "-"), F.array_join("bonus", "-")))
    d = d.withColumn("_copies", copies).withColumn("_actual", actual)
    d = with_draw(d, days)
    named = lambda errors, zone: F.transform(errors, lambda e: F.concat(F.lit(f"{zone}_"), e))
    found = F.concat(
        named(number_errors(F.col("main"), size, 1, high), "main"), named(number_errors(F.col("bonus"), 1, 1, bonus_high), "bonus"),
        F.filter(F.array(F.when(F.col("_copies") > 1, "copy"), F.when(F.col("_actual") != F.col("declared"), "batch_size"), F.when(F.to_date("generated") > F.col("draw_date"), "drawn")), lambda x: x.isNotNull()),
    )
    return d.select("ticket_id", found.alias("problems")).where(F.size("problems") > 0)


def audit_feedback(feedback: DataFrame, draws: DataFrame) -> DataFrame:
    """(ticket_id, kind) of everything in which recorded feedback differs from what its true draw gives.

    Kinds: no_draw, numbers, hits, total, grade, valid.  ``feedback`` records
    front, back, h, j, total, grade and valid next to the ticket's numbers, its
    times and its source.
    """
    # masks and texts of the numbers are a third as wide as their arrays, and all of a row that meets its draw
    text = lambda c: F.array_join(c, ",", "-")
    true = draws.select(F.col("k").alias("draw_k"), number_mask(F.col("front")).alias("_dm"), number_mask(F.col("back")).alias("_db"), text(F.array_sort("front")).alias("_front"), text(F.col("back")).alias("_back"), F.col("draw_date").alias("_day"))
    own = feedback.select("ticket_id", "draw_k", number_mask(F.col("main")).alias("_tm"), number_mask(F.col("bonus")).alias("_tb"), text(F.array_sort("front")).alias("front"), text(F.col("back")).alias("back"), "h", "j", "total", "grade", "valid", "generated", "predicted", "source")
    d = with_draw(own, true).withColumn("_h", zone_hits(F.col("_tm"), F.col("_dm"))).withColumn("_j", zone_hits(F.col("_tb"), F.col("_db")))
    table = rules(feedback.sparkSession).select(F.col("h").alias("_h"), F.col("j").alias("_j"), F.col("grade").alias("_grade"))
    d = d.join(F.broadcast(table), ["_h", "_j"], "left")
    known = F.col("_day").isNotNull()
    valid = is_valid_prediction(F.col("generated"), F.col("_day"), F.col("predicted"), F.col("source"))
    kinds = (
        ("no_draw", ~known), ("numbers", known & ((F.col("front") != F.col("_front")) | (F.col("back") != F.col("_back")))), ("hits", known & ((F.col("h") != F.col("_h")) | (F.col("j") != F.col("_j")))),
        ("total", known & F.col("total").isNotNull() & (F.col("total") != F.col("_h") + F.col("_j"))), ("grade", known & ~F.col("grade").eqNullSafe(F.col("_grade"))), ("valid", known & (F.col("valid") != valid)),
    )
    found = F.filter(F.array(*(F.when(c, n) for n, c in kinds)), lambda x: x.isNotNull())
    return d.select("ticket_id", F.explode(found).alias("kind"))


def feedback_health(feedback: DataFrame, draws: DataFrame | None, cap: float) -> DataFrame:
    """Per game: records made after their draw day, share of unknown amounts and whether it is over ``cap``, rule versions in use.

    Without ``draws``, ``feedback`` has its draw's lottery and draw_date itself.
    """
    if draws is not None:
        feedback = feedback.join(draws.select(F.col("k").alias("draw_k"), "lottery", "draw_date"), "draw_k")
    g = feedback.groupBy("lottery").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.to_date("generated") > F.col("draw_date"), 1)).alias("late"), F.round(F.count(F.when(F.col("amount").isNull(), 1)) / F.count(F.lit(1)), 6).alias("unknown"), F.countDistinct("version").alias("versions")
    )
    return g.withColumn("over_cap", F.col("unknown") > cap)


def count_reconcile(feedback: DataFrame, configured: int) -> DataFrame:
    """(lottery, issue, batch, rows, verdict): internal if the declared sizes differ among each other or from the rows, shortfall if fewer came than asked for, drift if the game's last batch is not of the configured size, else ok."""
    g = feedback.groupBy("lottery", "issue", "batch").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("declared").alias("sizes"), F.min("declared").alias("declared"), F.min("requested").alias("requested"))
    last = F.broadcast(g.groupBy("lottery").agg(F.max(F.struct("issue", "batch")).alias("last")))  # one row a game
    wrong = (F.col("sizes") > 1) | ((F.col("sizes") == 1) & (F.col("declared") != F.col("rows")))
    verdict = F.when(wrong, "internal").when(F.col("requested") != F.col("rows"), "shortfall").when((F.struct("issue", "batch") == F.col("last")) & (F.col("rows") != configured), "drift").otherwise("ok")
    return g.join(last, "lottery").select("lottery", "issue", "batch", "rows", verdict.alias("verdict"))


def quality_score(failed: Column, tests: Column, dup_z: Column, gaps: Column) -> Column:
    """0 to 100: 100 times the share of tests not failed, less up to 15 for repeats beyond z 5 and up to 5 for gaps."""
    base = F.when(tests > 0, 100.0 * (1 - failed / tests)).otherwise(100.0)
    repeats = F.when(dup_z > 5, F.least(F.lit(15.0), 5.0 * (dup_z - 4))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - repeats - F.least(F.lit(5.0), gaps * 0.5)))


def data_quality_report(draws: DataFrame, gaps: DataFrame, repeats: DataFrame, size: int, choose: int, alpha: float = 0.05) -> DataFrame:
    """Per game: tests failed in a practical sense after Benjamini-Hochberg, score and grade A to D.

    ``gaps`` has the games' missing issues (lottery, missing), ``repeats`` their
    duplicate excess (lottery, z).  Practical: V of 0.1, |z| of 3, 5 % of the
    share of repeats.
    """
    chi = uniformity(frequency(draw_numbers(draws), size), choose)
    tests = chi.select("lottery", F.lit("uniformity").alias("test"), special.chi2_sf(F.col("chi2"), F.col("df").cast("double")).alias("p"), (F.col("v") >= 0.10).alias("large"))
    tests = tests.unionByName(runs_test(draws).select("lottery", F.lit("runs").alias("test"), special.norm_two_sided("z").alias("p"), (F.abs("z") >= 3).alias("large")))
    tests = tests.unionByName(adjacent_repeat(draws, size, choose).select("lottery", F.lit("adjacent").alias("test"), special.norm_two_sided("z").alias("p"), (F.abs("effect") >= 0.05).alias("large")))
    adjusted = bh_adjust(tests, "p", ["lottery"], ["test"])
    g = adjusted.groupBy("lottery").agg(F.count(F.lit(1)).alias("tests"), F.count(F.when((F.col("p_adjusted") <= alpha) & F.col("large"), 1)).alias("failed"))
    g = g.join(gaps.groupBy("lottery").agg(F.sum("missing").alias("gaps")), "lottery", "left").join(repeats.select("lottery", F.col("z").alias("dup_z")), "lottery", "left").fillna(0, ["gaps"])
    g = g.withColumn("score", F.round(quality_score(F.col("failed"), F.col("tests"), F.coalesce("dup_z", F.lit(0.0)), F.col("gaps")), 1))
    return g.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D"))
