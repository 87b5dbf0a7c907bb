"""Strategies and their evaluation over draws, batches and pools of tickets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import number_mask
from .draw_stats import past_counts
from .order import by, by_stretches, cells, quantiles, rank_by_parts, stretched, upto, with_order



def _picked(d: DataFrame, picks: Column) -> DataFrame:
    d = d.withColumn("_picks", F.array_sort(picks))
    return d.select("lottery", "ord", F.array_join("_picks", "-").alias("numbers"), F.size(F.array_intersect("_picks", "front")).cast("bigint").alias("hits"))


def strategy_balanced(draws: DataFrame, size: int, width: int, choose: int) -> DataFrame:
    """The hottest numbers of each third of the range, as many of each as the quota says, and how many came."""
    cuts = (1, 1 + size // 3, 1 + 2 * size // 3, size)
    thirds = ((cuts[0], cuts[1]), (cuts[1] + 1, cuts[2]), (cuts[2] + 1, cuts[3]))
    quota = [choose // 3 + (i < choose % 3) for i in range(3)]
    hottest = lambda lo, hi, n: F.transform(F.slice(F.array_sort(F.transform(F.slice("counts", lo, hi - lo + 1), lambda c, i: F.struct((-c).alias("c"), (i.cast("bigint") + lo).alias("num")))), 1, n), lambda x: x["num"])
    return _picked(past_counts(draws, size, width), F.concat(*(hottest(lo, hi, n) for (lo, hi), n in zip(thirds, quota, strict=True))))


def strategy_random(draws: DataFrame, size: int, choose: int, k: int, seed: int) -> DataFrame:
    """(lottery, ord, ticket, numbers, hits): ``k`` random tickets for every draw, in the order of md5 of seed, draw, ticket and number."""
    d = with_order(draws).select("lottery", "ord", "front").withColumn("ticket", F.explode(F.sequence(F.lit(1), F.lit(k))))
    mark = lambda num: F.md5(F.concat_ws(":", F.lit(str(seed)), "lottery", F.col("ord").cast("string"), F.col("ticket").cast("string"), num.cast("string")))
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda n: F.struct(mark(n).alias("m"), n.cast("bigint").alias("num"))))
    d = d.withColumn("_picks", F.array_sort(F.transform(F.slice(order, 1, choose), lambda x: x["num"])))
    return d.select("lottery", "ord", "ticket", F.array_join("_picks", "-").alias("numbers"), F.size(F.array_intersect("_picks", "front")).cast("bigint").alias("hits"))


def strategy_rules(candidates: DataFrame, odd: tuple[int, int], complexity: int, thirds: int) -> DataFrame:
    """Candidates (with ``shape`` columns) whose odd count is in range, complexity high enough, no third over its limit, and no run of three."""
    return candidates.where(F.col("odd").between(*odd) & (F.col("complexity") >= complexity) & (F.greatest("third1", "third2", "third3") <= thirds) & ~F.col("triple"))


def rolling_mode(series: DataFrame, width: int = 200, values: int = 10) -> DataFrame:
    """Per game and position: how often the commonest digit of the ``width`` draws before (of equals the least) came next, against 1 / values.

    A stretch's running counts are kept once and subtracted, so a draw costs the same whatever the width.
    """
    positions = 5

    def count(table: pa.Table) -> dict[str, pa.Array]:
        rows, places, digits = cells(table["digits"])
        fits = (places < positions) & (digits >= 0) & (digits < values)
        seen = np.zeros((len(table), positions, values), bool)
        seen[rows[fits], places[fits], digits[fits]] = True
        own = np.flatnonzero(~table["lead"].to_numpy() & (table["ord"].to_numpy() > width))
        sums = upto(seen)
        mode = (sums[own] - sums[np.maximum(own - width, 0)]).argmax(2)  # of equals the first
        hit = np.take_along_axis(seen[own], mode[:, :, None], 2)[:, :, 0].sum(0)
        some = range(positions) if len(own) else []
        return {"lottery": pa.array([table["lottery"][0].as_py()] * len(some), pa.string()), "pos": pa.array(some, pa.int32()), "n": pa.array([len(own)] * len(some), pa.int64()), "hits": pa.array(hit[: len(some)], pa.int64())}

    d = by_stretches(stretched(with_order(series).select("lottery", "ord", "digits"), width), count, "lottery string, pos int, n long, hits long")
    g = d.groupBy("lottery", "pos").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    out = g.select("lottery", "pos", "n", "hits", F.round((F.col("hits") - F.col("n") / values) / F.sqrt(F.col("n") * (1 / values) * (1 - 1 / values)), 5).alias("z"))
    return out.withColumn("p", special.binom_test(F.col("hits").cast("double"), F.col("n").cast("double"), F.lit(1 / values)))


def hit_histogram(picks: DataFrame, min_train: int) -> DataFrame:
    """Draws by hits of a strategy, with its mean and most (a row a number of hits)."""
    g = picks.where(F.col("ord") > min_train).groupBy("lottery", "hits").agg(F.count(F.lit(1)).alias("draws"))
    every = Window.partitionBy("lottery")  # a row a number of hits
    return g.select("lottery", "hits", "draws", F.round(F.sum(F.col("hits") * F.col("draws")).over(every) / F.sum("draws").over(every), 6).alias("mean"), F.max("hits").over(every).alias("most"))


def anchor_backtest(picks: DataFrame, baseline: DataFrame, trials: int, seed: int) -> DataFrame:
    """A strategy against a random ticket on ``trials`` draws of each game, chosen by md5 of seed and draw: mean paired difference and z."""
    both = picks.select("lottery", "ord", F.col("hits").alias("a")).join(baseline.select("lottery", "ord", F.col("hits").alias("b")), ["lottery", "ord"])
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), "lottery", F.col("ord").cast("string")))
    d = both.withColumn("_place", F.row_number().over(Window.partitionBy("lottery").orderBy(mark))).where(F.col("_place") <= trials)  # a top-n of each task first
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("trials"), F.avg(F.col("a") - F.col("b")).alias("d"), F.stddev(F.col("a") - F.col("b")).alias("s"))
    return g.select("lottery", "trials", F.round("d", 6).alias("difference"), F.round(F.col("d") / (F.col("s") / F.sqrt("trials")), 5).alias("z"))


def gate_series(draws: DataFrame, p: dict[str, float]) -> DataFrame:
    """Gate per rule version from draws (version, K tickets, ``reached`` of them): share of draws reached, its error, K p, the random baseline 1 - (1 - p)^K and efficiency.

    ``p`` is the chance of a ticket to reach the gate by version.
    """
    table = F.create_map(*(F.lit(x) for kv in p.items() for x in kv))
    d = draws.withColumn("p", table[F.col("version")])
    g = d.groupBy("version").agg(F.count(F.lit(1)).alias("draws"), F.count(F.when(F.col("reached") > 0, 1)).alias("hit"), F.avg(F.col("K") * F.col("p")).alias("kp"), F.avg(1 - F.pow(1 - F.col("p"), F.col("K"))).alias("base"))
    share = F.col("hit") / F.col("draws")
    return g.select("version", "draws", "hit", F.round(share, 6).alias("share"), F.round(F.sqrt(share * (1 - share) / F.col("draws")), 6).alias("se"), F.round("kp", 6).alias("kp"), F.round("base", 6).alias("baseline"), F.round(share / F.least(F.lit(1.0), F.col("kp")), 6).alias("efficiency"))


def prefix_curve(settled: DataFrame, ks: list[int], price: int = 2, gate: int = 5) -> DataFrame:
    """The first k tickets of every batch, for each k: batches, cost, gross, mean main hits, share of batches with a prize of ``gate`` or more, gross without the largest batch."""
    w = Window.partitionBy("batch").orderBy("ticket_id", "h", "j")
    d = settled.where("status = 'evaluated'").select("batch", "amount", "h", F.row_number().over(w).alias("seq"))
    first = lambda f, k, c: f(F.when(F.col("seq") <= k, c))
    # all k of a batch in one row, so tickets are not copied and batches not shuffled again
    parts = {"n": (F.count, F.lit(1)), "gross": (F.sum, F.col("amount")), "h": (F.sum, F.col("h")), "won": (F.max, (F.col("amount") >= gate).cast("int"))}
    per = d.groupBy("batch").agg(*(first(f, k, c).alias(f"{n}_{k}") for k in ks for n, (f, c) in parts.items()))
    per = per.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}_{k}").alias(n) for n in parts)) for k in ks))).alias("x")).select("x.*").where("n > 0")
    g = per.groupBy("k").agg(F.count(F.lit(1)).alias("batches"), (F.sum("n") * price).alias("cost"), F.sum("gross").alias("gross"), F.round(F.sum("h") / F.sum("n"), 6).alias("mean_hits"), F.round(F.avg("won"), 6).alias("rate"), (F.sum("gross") - F.max("gross")).alias("without_largest"))
    return g


def distance_profile(settled: DataFrame, draws: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(arm, distance, n) of ``size`` minus hits for evaluated tickets, and for each draw against the one 17 places on in md5 order as random pairs."""
    seen = settled.where("status = 'evaluated'").groupBy((F.lit(size) - F.col("h") - F.col("j")).cast("bigint").alias("distance")).agg(F.count(F.lit(1)).alias("n")).withColumn("arm", F.lit("observed"))
    w = Window.partitionBy("lottery", "issue_year").orderBy(F.md5(F.col("k").cast("string")))
    d = draws.select("lottery", "front", "back", F.lead("front", 17).over(w).alias("f2"), F.lead("back", 17).over(w).alias("b2")).where("f2 is not null")
    pairs = d.groupBy((F.lit(size) - F.size(F.array_intersect("front", "f2")) - F.size(F.array_intersect("back", "b2"))).cast("bigint").alias("distance")).agg(F.count(F.lit(1)).alias("n")).withColumn("arm", F.lit("random"))
    both = seen.unionByName(pairs).select("arm", "distance", "n")
    every = Window.partitionBy("arm")  # a row a distance
    run = F.sum("n").over(Window.partitionBy("arm").orderBy("distance"))
    upto = both.withColumn("run", run).withColumn("total", F.sum("n").over(every))
    low = F.min(F.when(F.col("run") * 2 >= F.col("total"), F.col("distance")))
    high = F.min(F.when(F.col("run") * 2 > F.col("total"), F.col("distance")))
    summary = upto.groupBy("arm").agg(F.max("total").alias("n"), ((low + high) / 2).alias("median"), F.round(F.sum(F.when(F.col("distance") <= 1, F.col("n")).otherwise(0)) / F.max("total"), 6).alias("near"))
    return both, summary


def calibration(predictions: DataFrame, bins: int = 10, least: int = 5) -> DataFrame:
    """(bin, n, predicted, actual, error): the calibration curve of (p, y), with the error weighted over bins of ``least`` or more."""
    d = predictions.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("a"), F.avg("y").alias("b"))
    every = Window.partitionBy()  # a row a bin
    big = F.col("n") >= least
    error = F.sum(F.when(big, F.abs(F.col("a") - F.col("b")) * F.col("n"))).over(every) / F.sum(F.when(big, F.col("n"))).over(every)
    return d.select("bin", "n", F.round("a", 6).alias("predicted"), F.round("b", 6).alias("actual"), F.round(F.coalesce(error, F.lit(1.0)), 6).alias("error"))


def same_budget(rows: DataFrame) -> DataFrame:
    """Arms (arm, issue, n, cost, gross, settled, wins) side by side; comparable only with the same issues and counts as the first arm."""
    first = rows.groupBy().agg(F.min("arm").alias("_first"))
    base = rows.join(F.broadcast(first), F.col("arm") == F.col("_first")).select("issue", F.col("n").alias("_n"))  # one row
    arms = rows.select("arm").distinct()
    wanted = arms.crossJoin(F.broadcast(base.agg(F.count(F.lit(1)).alias("_issues"))))  # one row
    agree = rows.join(base, "issue", "left").groupBy("arm").agg(F.count(F.when(F.col("n") == F.col("_n"), 1)).alias("_same"), F.count(F.lit(1)).alias("_all"))
    g = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("issues"), F.sum("cost").alias("cost"), F.sum(F.when(F.col("settled"), F.col("cost")).otherwise(0)).alias("settled_cost"), F.sum(F.when(F.col("settled"), F.col("gross"))).alias("gross"), F.sum("wins").alias("wins"))
    out = g.join(agree, "arm").join(wanted, "arm")
    return out.select("arm", "issues", "cost", "settled_cost", "gross", "wins", F.round(F.try_divide(F.col("gross"), F.col("settled_cost")) - 1, 6).alias("net_rate"), ((F.col("_same") == F.col("_issues")) & (F.col("_all") == F.col("_issues"))).alias("comparable"))


def top_numbers(tickets: DataFrame, group: list[str], top: int) -> DataFrame:
    """(*group, numbers): the ``top`` numbers that most tickets of a group hold."""
    c = tickets.select(*group, F.explode("main").alias("num")).groupBy(*group, "num").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "num")))  # one row a number of the game
    return c.groupBy(*group).agg(F.array_sort(F.transform(F.slice(order, 1, top), lambda x: x["num"])).alias("numbers"))


def window_stability(tickets: DataFrame, top: int) -> DataFrame:
    """Per tier: mean Jaccard of the top numbers of different windows over that of two seeds of one window, within 0 to 1.

    ``tickets`` has tier, window, seed and main.
    """
    t = top_numbers(tickets, ["tier", "window", "seed"], top)
    u = t.select("tier", F.col("window").alias("w2"), F.col("seed").alias("s2"), F.col("numbers").alias("n2"))
    j = F.size(F.array_intersect("numbers", "n2")) / F.size(F.array_union("numbers", "n2"))
    pairs = t.join(u, "tier").where("(window < w2 and seed = s2) or (window = w2 and seed < s2)").withColumn("j", j)  # windows x seeds a tier
    g = pairs.groupBy("tier").agg(F.avg(F.when(F.col("window") < F.col("w2"), F.col("j"))).alias("across"), F.avg(F.when(F.col("window") == F.col("w2"), F.col("j"))).alias("noise"))
    return g.select("tier", F.round("across", 6).alias("across"), F.round("noise", 6).alias("noise"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("across"), F.col("noise")))), 6).alias("stability"))


#: Weights of frequency, omission and spread in a ticket's score, their share of the whole, and the thirds of the numbers.
SCORE_WEIGHTS, SCORE_SHARE = (0.4, 0.3, 0.3), 0.85
THIRDS = ((1, 11), (11, 22), (22, 34))


def score_tickets(tickets: DataFrame, freq: DataFrame, omitted: DataFrame, draws_seen: Column, size: int, weights: tuple[float, float, float] = SCORE_WEIGHTS) -> DataFrame:
    """(ticket_id, lottery, score): 0.85 times closeness of the numbers' frequencies to the mean, of their omissions to even spread, and balance over the thirds, by ``weights``.

    The remaining 0.15 is for a historical hit rate, which is added where known.
    """
    stats = freq.groupBy("lottery").agg(F.avg("times").alias("_mean"), F.max("times").alias("_max"))
    table = freq.join(omitted, ["lottery", "num"]).join(stats, "lottery")
    close = 1 - F.least(F.lit(1.0), F.abs(F.col("times") - F.col("_mean")) / F.greatest(F.col("_max") - F.col("_mean"), F.lit(1)))
    ideal = draws_seen / size
    late = 1 - F.least(F.lit(1.0), F.abs(F.col("omitted") - ideal) / ideal)
    per = F.broadcast(table.select("lottery", "num", close.alias("_hot"), late.alias("_late")))  # games x numbers
    d = tickets.select("ticket_id", "lottery", "main", F.explode("main").alias("num")).join(per, ["lottery", "num"])
    g = d.groupBy("ticket_id", "lottery", "main").agg(F.avg("_hot").alias("h"), F.avg("_late").alias("l"))
    n = F.size("main")
    parts = [F.size(F.filter("main", lambda x: (x >= lo) & (x < hi))) for lo, hi in THIRDS]
    spread = 1 - F.least(F.lit(1.0), sum((F.abs(p - n / 3) for p in parts), F.lit(0.0)) / 3 / n)
    w = [x * SCORE_SHARE / sum(weights) for x in weights]
    return g.select("ticket_id", "lottery", F.round(w[0] * F.col("h") + w[1] * F.col("l") + w[2] * spread, 6).alias("score"))


def _rank_cuts(scored: DataFrame, parts: dict[str, int]) -> DataFrame:
    """(lottery, window, *_score, *_id): score and id of the last ticket of the better 1 / part of each game and window, best score first, then least id; null if that is none.

    Scores are counted, the one at the rank is found by ranges of scores and
    within the range that holds it, and only tickets of that score are ranked by id.
    """
    by_window = ["lottery", "window"]
    counts = scored.groupBy(*by_window, "score").agg(F.count(F.lit(1)).alias("_c"))
    bounds = counts.groupBy(*by_window).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.sum("_c").alias("_n"))
    d = counts.join(F.broadcast(bounds), by_window)  # a row a game and window
    d = d.withColumn("_range", F.coalesce(F.floor((F.col("score") - F.col("_lo")) * 512.0 / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))), F.lit(-1)))
    from_top = lambda *g: Window.partitionBy(*by_window, *g)
    per = d.groupBy(*by_window, "_range").agg(F.sum("_c").alias("_in"))
    per = per.withColumn("_above", F.sum("_in").over(from_top().orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in"))  # one row a range
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f"_n div {p}").alias("rank")) for k, p in parts.items())))
    d = d.join(F.broadcast(per), [*by_window, "_range"]).withColumn("w", wanted).where("w.rank > _above and w.rank <= _above + _in")
    d = d.withColumn("_upto", F.col("_above") + F.sum("_c").over(from_top("w.kind", "_range").orderBy(F.col("score").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)))
    at = d.where("_upto >= w.rank and _upto - _c < w.rank").select(*by_window, F.col("score").alias("_score"), F.col("w.kind").alias("kind"), (F.col("w.rank") - F.col("_upto") + F.col("_c")).alias("_take"))
    tied = scored.join(F.broadcast(at), by_window).where(F.col("score").eqNullSafe(F.col("_score"))).select(*by_window, "kind", "score", "_take", "ticket_id")  # a row a game, window and part
    last = rank_by_parts(tied, [*by_window, "kind"], F.expr("ticket_id div 65536"), ["ticket_id"], "_at").where("_at = _take")
    ends = last.groupBy(*by_window).agg(*(f(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{n}") for k in parts for f, c, n in ((F.max, "score", "score"), (F.max, "ticket_id", "id"))))
    return bounds.select(*by_window).join(ends, by_window, "left")


def consensus_tier(scored: DataFrame, share: float, top: int) -> DataFrame:
    """Tickets by (share of windows in which they rank in the better half) times mean score; those under ``share`` are out; the ``top`` of each game.

    ``scored`` has lottery, ticket_id, window and score.
    """
    cuts = F.broadcast(_rank_cuts(scored, {"half": 2, "quarter": 4}))  # a row a game and window
    within = lambda kind: F.coalesce((F.col("score") > F.col(f"{kind}_score")) | (F.col("score") == F.col(f"{kind}_score")) & (F.col("ticket_id") <= F.col(f"{kind}_id")), F.lit(False)).cast("int")
    d = scored.join(cuts, ["lottery", "window"]).select("lottery", "ticket_id", "score", within("half").alias("_half"), within("quarter").alias("_quarter"))
    g = d.groupBy("lottery", "ticket_id").agg(F.avg("_half").alias("half"), F.avg("_quarter").alias("quarter"), F.avg("score").alias("mean")).where(F.col("half") >= share)
    g = g.withColumn("consensus", F.round(F.col("half") * F.col("mean"), 6))
    w = Window.partitionBy("lottery").orderBy(F.col("consensus").desc(), "ticket_id")
    return g.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top).select("lottery", "place", "ticket_id", F.round("half", 6).alias("half"), F.round("quarter", 6).alias("quarter"), "consensus")


def rank_agreement(ranked: DataFrame) -> DataFrame:
    """Per game Kendall's tau of two rankings a and b of its numbers, and the sensitivity 1 - (1 + tau) / 2."""
    other = ranked.select("lottery", F.col("num").alias("n2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    pairs = ranked.join(other, "lottery").where("num < n2")  # pairs of a game's numbers
    g = pairs.groupBy("lottery").agg(F.avg(F.signum((F.col("a") - F.col("a2")).cast("double")) * F.signum((F.col("b") - F.col("b2")).cast("double"))).alias("t"))
    return g.select("lottery", F.round("t", 6).alias("tau"), F.round(1 - (1 + F.col("t")) / 2, 6).alias("sensitivity"))


def value_coverage(tickets: DataFrame, zone: str, high: int) -> DataFrame:
    """(batch, missing): the values 1..high that no ticket of a batch has in a single-number zone."""
    g = tickets.groupBy("batch").agg(F.collect_set(F.element_at(zone, 1)).alias("have"))  # at most ``high`` values
    return g.select("batch", F.array_join(F.array_except(F.transform(F.sequence(F.lit(1), F.lit(high)), lambda x: x.cast("bigint")), "have"), "-").alias("missing"))


def prune_overlap(tickets: DataFrame, cap: int, target: Column, keep_per_strategy: int = 1) -> DataFrame:
    """(batch, ticket_id, kept, reason) by greedy choice within each batch, best score first.

    First every strategy gets ``keep_per_strategy`` tickets, within the cap of
    common main numbers if it has any, else its best; then the others while
    within the cap and under the batch's ``target``.  Batches are tickets of one
    order, so a group is small.
    """
    t = tickets.select("batch", "ticket_id", "strategy", "score", number_mask(F.col("main")).alias("mask"), target.cast("int").alias("target"))
    parts = 8 + tickets.count() // 20_000  # whole batches, many in a part
    t = t.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(parts)))

    def pick(masks: list[int], strategies: list, target: int) -> list[str]:
        taken: list[int] = []
        reason = ["overlap"] * len(masks)
        fits = lambda i: all((masks[i] & masks[j]).bit_count() <= cap for j in taken)
        for _ in range(keep_per_strategy):
            for s in dict.fromkeys(strategies):
                own = [i for i in range(len(masks)) if strategies[i] == s and i not in taken]
                best = next((i for i in own if fits(i)), own[0] if own else None)
                if best is not None:
                    taken.append(best)
                    reason[best] = "floor"
        for i in range(len(masks)):
            if i in taken:
                continue
            if len(taken) >= target:
                reason[i] = "target"
            elif fits(i):
                taken.append(i)
                reason[i] = "fits"
        return reason

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["batch", "score", "ticket_id"], ascending=[True, False, True], kind="stable")
        cuts = np.flatnonzero(np.diff(part["batch"].to_numpy(), prepend=part["batch"].iloc[0] - 1)).tolist() + [len(part)]
        masks, strategies, targets = part["mask"].tolist(), part["strategy"].tolist(), part["target"].tolist()
        reason = [r for lo, hi in zip(cuts, cuts[1:], strict=False) for r in pick(masks[lo:hi], strategies[lo:hi], targets[lo])]
        return pd.DataFrame({"batch": part["batch"], "ticket_id": part["ticket_id"], "kept": [r in ("floor", "fits") for r in reason], "reason": reason})

    return t.groupBy("part").applyInPandas(choose, "batch long, ticket_id long, kept boolean, reason string")


def compare_latest(settled: DataFrame) -> DataFrame:
    """Per strategy the tickets of its last draw day against all before: tickets, mean main hits, best."""
    d = settled.where("status = 'evaluated'")
    last = d.groupBy("strategy").agg(F.max("draw_date").alias("_last"))
    d = d.join(F.broadcast(last), "strategy").withColumn("_new", F.col("draw_date") == F.col("_last"))  # one row a strategy
    part = lambda f, c, h: f(F.when(c, F.col(h)))
    return d.groupBy("strategy").agg(
        F.count(F.when(F.col("_new"), 1)).alias("latest"), F.round(part(F.avg, F.col("_new"), "h"), 6).alias("latest_mean"), part(F.max, F.col("_new"), "h").cast("bigint").alias("latest_best"), F.round(part(F.avg, ~F.col("_new"), "h"), 6).alias("earlier_mean")
    )


def conformal_table(first_hits: DataFrame, ks: list[int], confidence: float = 0.95) -> DataFrame:
    """Per k of the grid: calibration draws that a ticket among the first k hits, the level k_pass / (n + 1) that may be claimed, and the exact lower bound.

    ``first_hits`` has one row per draw with ``first`` (null: no ticket hits).
    """
    d = first_hits.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.coalesce(F.col("first"), F.lit(2**31)) <= k).cast("int").alias("hit")) for k in ks))).alias("x"))
    g = d.groupBy("x.k").agg(F.count(F.lit(1)).alias("n"), F.sum("x.hit").alias("passed"))
    out = g.select("k", "n", "passed", F.round(F.col("passed") / (F.col("n") + 1), 6).alias("level"))
    n, k = F.col("n").cast("double"), F.col("passed").cast("double")
    exact = F.when(F.col("passed") == 0, 0.0).when(F.col("passed") >= F.col("n"), F.pow(F.lit(1 - confidence), 1 / n))
    return out.withColumn("bound", F.coalesce(exact, special.beta_ppf(F.lit(1 - confidence), F.when(k > 0, k), F.when(k < n, n - k + 1))))


def first_hits(tickets: DataFrame, draws: DataFrame, least: int) -> DataFrame:
    """(lottery, issue_year, issue_seq, first): the least ``seq`` of a frozen list of tickets with ``least`` main hits or more.

    Tickets are met by the subsets of ``least`` of their numbers, so no ticket is
    paired with every draw.
    """
    subsets = lambda c: F.filter(_subset_masks(c), lambda m: F.bit_count(m) == least)
    per = tickets.select("seq", F.explode(subsets(F.array_sort("main"))).alias("m")).groupBy("m").agg(F.min("seq").alias("seq"))
    kinds = draws.select(F.array_sort("front").alias("f")).distinct()
    found = kinds.select("f", F.explode(subsets(F.col("f"))).alias("m")).join(per, "m").groupBy("f").agg(F.min("seq").alias("first"))
    return draws.select("lottery", "issue_year", "issue_seq", F.array_sort("front").alias("f")).join(found, "f", "left").drop("f")


def _subset_masks(numbers: Column) -> Column:
    from .settle import _subsets

    return _subsets(numbers)


def subset_coverage(tickets: DataFrame, t: int, v: int) -> DataFrame:
    """(covered, total, share) of the t-subsets of v numbers that some ticket holds."""
    from math import comb

    masks = tickets.select(F.array_sort("main").alias("main")).distinct().select(F.explode(F.filter(_subset_masks(F.col("main")), lambda m: F.bit_count(m) == t)).alias("m")).distinct()
    return masks.agg(F.count(F.lit(1)).alias("covered")).select("covered", F.lit(comb(v, t)).cast("bigint").alias("total"), F.round(F.col("covered") / comb(v, t), 9).alias("share"))


def exact_union(tickets: DataFrame, universe: DataFrame, least: int) -> DataFrame:
    """(outcomes, reached, wins): over all combinations, how many give some ticket ``least`` hits or more, and how many tickets win in all.

    Outcomes meet tickets by shared subsets of ``least`` numbers; a ticket with
    more hits shares several and counts once for the union, by inclusion and
    exclusion for the wins.
    """
    from math import comb

    size = 6
    distinct = tickets.groupBy(F.array_sort("main").alias("main")).agg(F.count(F.lit(1)).alias("n"))
    big = lambda c: F.filter(_subset_masks(c), lambda m: F.bit_count(m) >= least)
    per = distinct.select("n", F.explode(big(F.col("main"))).alias("m")).groupBy("m").agg(F.sum("n").alias("n"))
    out = universe.select(F.array_join("numbers", "-").alias("o"), F.explode(big(F.col("numbers"))).alias("m")).join(per, "m")
    # tickets with s hits share comb(s, t) subsets of t numbers: those with ``least`` or more are a signed sum over t
    sign = {t: (-1) ** (t - least) * comb(t - 1, least - 1) for t in range(least, size + 1)}
    weight = F.create_map(*(F.lit(x) for kv in sign.items() for x in kv))[F.bit_count("m")]
    g = out.groupBy("o").agg(F.sum(F.col("n") * weight).alias("wins"))
    total = universe.agg(F.count(F.lit(1)).alias("outcomes"))
    return g.agg(F.count(F.lit(1)).alias("reached"), F.sum("wins").alias("wins")).crossJoin(F.broadcast(total)).select("outcomes", "reached", "wins")  # one row


def combination_universe(spark, n: int, k: int) -> DataFrame:
    """(numbers): all C(n, k) combinations in order, grown a number at a time from ``spark.range``."""
    d = spark.range(1, n - k + 2).select(F.array("id").alias("numbers"))
    for i in range(1, k):
        d = d.select(F.explode(F.sequence(F.element_at("numbers", -1) + 1, F.lit(n - k + i + 1).cast("bigint"))).alias("x"), "numbers").select(F.array_append("numbers", F.col("x")).alias("numbers"))
    return d


def midrank_quantile(universe: DataFrame, asked: DataFrame) -> DataFrame:
    """(…, score, quantile): the mid-rank (count below + count up to) / 2M of each asked score in the universe's scores.

    The universe is counted per distinct score first; only those are ranked.
    """
    c = universe.groupBy("score").agg(F.count(F.lit(1)).alias("c")).withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct score
    ranked = c.withColumn("_upto", F.sum("c").over(w)).withColumn("_all", F.sum("c").over(Window.partitionBy("one")))
    table = ranked.select("score", F.round((2 * F.col("_upto") - F.col("c")) / (2 * F.col("_all")), 9).alias("quantile"))
    return asked.join(table, "score")




def trial_report(settled: DataFrame, a: str, b: str, margin: float = 0.1, c: float = 0.5) -> DataFrame:
    """Two strategies on the draws that both took part in, by money per ticket: draws, wins and losses of the first, mean difference, the log wealth of betting on its sign, and whether the means are within ``margin`` of each other."""
    import math

    per = settled.where((F.col("status") == "evaluated") & F.col("strategy").isin(a, b)).groupBy("lottery", "draw_k").agg(F.avg(F.when(F.col("strategy") == a, F.col("amount"))).alias("x"), F.avg(F.when(F.col("strategy") == b, F.col("amount"))).alias("y"))
    g = per.where("x is not null and y is not null").groupBy("lottery").agg(F.count(F.lit(1)).alias("draws"), F.count(F.when(F.col("x") > F.col("y"), 1)).alias("wins"), F.count(F.when(F.col("x") < F.col("y"), 1)).alias("losses"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    log = F.col("wins") * math.log1p(c) + F.col("losses") * math.log1p(-c)
    out = g.select("lottery", "draws", "wins", "losses", F.round(F.col("mx") - F.col("my"), 6).alias("difference"), F.round(log, 6).alias("log_wealth"), (F.abs(F.col("mx") - F.col("my")) <= margin * F.greatest("mx", "my")).alias("equivalent"))
    return out.withColumn("p", special.binom_test(F.col("wins").cast("double"), (F.col("wins") + F.col("losses")).cast("double"), F.lit(0.5)))


def trial_interval(settled: DataFrame, a: str, b: str, block: int = 20, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(lottery, n, mean, se, lo, hi): the mean difference of ``trial_report`` with a block bootstrap over the draws that both took part in."""
    from .resampling import block_means

    per = settled.where((F.col("status") == "evaluated") & F.col("strategy").isin(a, b)).groupBy("lottery", "draw_k").agg(F.avg(F.when(F.col("strategy") == a, F.col("amount"))).alias("x"), F.avg(F.when(F.col("strategy") == b, F.col("amount"))).alias("y"))
    each = per.where("x is not null and y is not null").select("lottery", "draw_k", (F.col("x") - F.col("y")).alias("x"))
    return block_means(rank_by_parts(each, ["lottery"], F.expr("draw_k div 8192"), ["draw_k"], "ord"), block, replicates, seed)


def ev_edge(series: DataFrame, cold: float, hot: float, p1: float, share: float, price: float = 2.0) -> DataFrame:
    """Per game the gain of a combination with ``cold`` times the mean sharers over one with ``hot`` times: mean, Cohen's d, share of draws with a gain, and the largest draw's part of all.

    Without a cap the shared prize is pool (1 - exp(-mu)) / mu.
    """
    lam = F.col("sales") / price * p1
    part = lambda f: (1 - F.exp(-lam * f)) / (lam * f)
    d = series.where("sales > 0").select("lottery", (F.col("pool") * share * p1 * (part(cold) - part(hot))).alias("x"))
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.stddev("x").alias("s"), F.avg((F.col("x") > 0).cast("int")).alias("positive"), F.max("x").alias("top"), F.sum("x").alias("all"))
    return g.select("lottery", "n", F.round("m", 6).alias("mean"), F.round(F.try_divide("m", "s"), 6).alias("d"), F.round("positive", 6).alias("positive"), F.round(F.try_divide("top", "all"), 6).alias("largest"))


#: Smoothing of the transitions and the weights of the three parts of a position's ranking.
SMOOTHING, PARTS = 0.5, (0.60, 0.25, 0.15)


def rank_positions(series: DataFrame, values: int = 10) -> DataFrame:
    """(lottery, pos, digit, score, place): the digits of each position by what follows its last digit, how overdue each is, and its neighbours' share.

    Counts, first and last places of a digit give its mean gap and omission, so
    the draws are put in order only for the transitions.
    """
    ordered = with_order(series).select("lottery", "ord", "digits")
    d = stretched(ordered, 1).withColumn("_prev", F.lag("digits").over(by())).where("not lead")
    cells = d.select("lottery", "ord", F.posexplode(F.arrays_zip(F.col("digits").alias("x"), F.coalesce("_prev", F.transform("digits", lambda _: F.lit(None).cast("bigint"))).alias("p"))).alias("pos", "z"))
    seen = cells.groupBy("lottery", "pos", F.col("z.x").alias("digit")).agg(F.count(F.lit(1)).alias("freq"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    ends = ordered.groupBy("lottery").agg(F.max(F.struct("ord", "digits")).alias("e")).select("lottery", F.col("e.ord").alias("n"), F.posexplode("e.digits").alias("pos", "now"))
    moves = cells.where("z.p is not null").groupBy("lottery", "pos", F.col("z.p").alias("now"), F.col("z.x").alias("digit")).agg(F.count(F.lit(1)).alias("moves"))
    every = ends.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(values - 1)))).withColumn("digit", F.col("digit").cast("bigint"))
    t = every.join(seen, ["lottery", "pos", "digit"], "left").join(moves, ["lottery", "pos", "now", "digit"], "left").fillna(0, ["freq", "moves"])
    place = Window.partitionBy("lottery", "pos")  # one row a digit
    total, out_of = F.sum("freq").over(place), F.sum("moves").over(place)
    markov = F.when(out_of > 0, (F.col("moves") + SMOOTHING) / (out_of + SMOOTHING * values)).otherwise(1 / values)
    gap = F.try_divide(F.col("last") - F.col("first"), F.col("freq") - 1)
    late = F.when(gap > 0, F.least(F.lit(1.0), (F.col("n") - F.coalesce("last", F.lit(0))) / gap)).otherwise(0.5)
    around = F.sum("freq").over(place.orderBy("digit").rangeBetween(-1, 1)) / total
    t = t.withColumn("score", F.round(PARTS[0] * markov + PARTS[1] * late + PARTS[2] * around, 6))
    return t.select("lottery", "pos", "digit", "score", F.row_number().over(place.orderBy(F.col("score").desc(), "digit")).cast("bigint").alias("place"))


def counterfactual_uplift(series: DataFrame, cold: float, hot: float, p1: float, price: float = 2.0) -> DataFrame:
    """Per game: the first prize of a combination with ``cold`` times the mean sharers over that of one with ``hot`` times, draw by draw: quartiles, and the median of the first and last half."""
    lam = F.col("sales") / price * p1
    part = lambda f: (1 - F.exp(-lam * f)) / (lam * f)
    d = with_order(series.where("sales > 0")).select("lottery", "ord", F.round(part(cold) / part(hot), 9).alias("x"))
    n = F.broadcast(d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n")))  # one row a game
    d = d.join(n, "lottery").withColumn("late", F.col("ord") * 2 > F.col("n"))
    halves = quantiles(d, ["lottery", "late"], "x", {"m": 0.5}).groupBy("lottery").agg(F.max(F.when(~F.col("late"), F.col("m"))).alias("first_half"), F.max(F.when(F.col("late"), F.col("m"))).alias("last_half"))
    q = quantiles(d, ["lottery"], "x", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return q.join(halves, "lottery").join(n, "lottery").select("lottery", "n", *(F.round(c, 6).alias(c) for c in ("p25", "median", "p75", "first_half", "last_half")))


def score_candidates(combos: DataFrame, pools: DataFrame, beta: float, p1: float, share: float, cap: float, top: int, price: float = 2.0) -> DataFrame:
    """(lottery, place, numbers, ev): each game's ``top`` combinations by expected net value under shared prizes.

    ``combos`` has main; ``pools`` one row a game with pool and sales.  A
    combination's mean sharers are the game's times exp(beta times its share of
    numbers up to 12, less 0.35).
    """
    popular = F.size(F.filter("main", lambda x: x <= 12)) / F.size("main") - 0.35
    c = combos.select(F.array_sort("main").alias("main"), F.exp(beta * popular).alias("f")).distinct()
    d = c.crossJoin(F.broadcast(pools.select("lottery", "pool", (F.col("sales") / price * p1).alias("lam"))))  # a row a game
    mu = F.col("lam") * F.col("f")
    ev = p1 * F.least(F.lit(cap), F.col("pool") * share * (1 - F.exp(-mu)) / mu) - price
    d = d.select("lottery", F.array_join("main", "-").alias("numbers"), "main", F.round(ev, 9).alias("ev"))
    w = Window.partitionBy("lottery").orderBy(F.col("ev").desc(), "numbers")
    return d.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top)  # a top-n of each task first


def select_topk(scored: DataFrame, cap: int, k: int) -> DataFrame:
    """Of each game's scored candidates, best first, ``k`` with at most ``cap`` numbers in common."""
    games = scored.select("lottery").distinct().select("lottery", F.row_number().over(Window.orderBy("lottery")).cast("bigint").alias("batch"))  # one row a game
    t = scored.join(F.broadcast(games), "lottery").select("batch", F.col("place").alias("ticket_id"), F.lit("").alias("strategy"), F.col("ev").alias("score"), "main")
    kept = prune_overlap(t, cap, F.lit(k), 0).where("kept").join(F.broadcast(games), "batch").select("lottery", F.col("ticket_id").alias("place"))
    return scored.join(kept, ["lottery", "place"]).select("lottery", "place", "numbers", "ev")
