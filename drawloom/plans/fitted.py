"""Queries on whole universes, walk-forward fits, likelihoods and resampling, with the SQL that checks what SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, table_functions
from ..operators import backtests as bt
from ..operators import draw_stats as st
from ..operators import hits as ht
from ..operators import likelihood as lk
from ..operators import resampling as rs
from ..operators import series as se
from ..operators import significance as sg
from ..operators import universe as un
from ..operators import walkforward as wf
from ..operators.order import medians, with_order
from ..operators.settle import settle
from . import bridge as br
from .bridge import DRAWS, SERIES, TICKETS
from .sql_parts import CELLS, ORD, SETTLED, SIZE

QUERIES, ORACLES = {}, {}


def _add(name, sql, make):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


#: Draws before the first refit, draws between refits, draws in a bootstrap block.
MIN_TRAIN, STEP, BLOCK = 240, 120, 20

UNIVERSE = "nb AS (SELECT unnest(range(1, 34)) AS x), u AS (SELECT a.x AS a, b.x AS b, c.x AS c, d.x AS d, e.x AS e, f.x AS f FROM nb a JOIN nb b ON b.x > a.x JOIN nb c ON c.x > b.x JOIN nb d ON d.x > c.x JOIN nb e ON e.x > d.x JOIN nb f ON f.x > e.x)"


def _drawn(s, d):
    """How often each outcome of the universe was drawn in each game, from its number."""
    return br.draws(s, d).groupBy("lottery", un.rank_column(F.array_sort(F.col("front").cast("array<bigint>")), 33, 6).alias("outcome")).agg(F.count(F.lit(1)).alias("times"))


def _universe_times(s, d):
    """How many of all outcomes came how often in each game; the outcomes meet the draws by their numbers."""
    drawn = _drawn(s, d)
    games = drawn.select("lottery").distinct()
    every = un.outcomes(s, 33, 6).select("outcome", F.element_at("numbers", 1).alias("first")).crossJoin(F.broadcast(games))  # one row a game
    met = every.join(drawn, ["lottery", "outcome"], "left")
    return met.groupBy("lottery", "first", F.coalesce("times", F.lit(0)).alias("times")).agg(F.count(F.lit(1)).alias("outcomes"))


_add(
    "e1_universe",
    f"WITH {DRAWS}, {UNIVERSE}, t AS (SELECT lottery, front, count(*) AS n FROM draws GROUP BY 1, 2), g AS (SELECT DISTINCT lottery FROM draws) SELECT g.lottery, a AS first, coalesce(t.n, 0)::BIGINT AS times, count(*) AS outcomes FROM u CROSS JOIN g LEFT JOIN t ON t.lottery = g.lottery AND t.front = [a, b, c, d, e, f] GROUP BY 1, 2, 3",
    _universe_times,
)


def _midrank(s, d):
    score = lambda c: F.aggregate(F.transform(c, lambda x, i: x * x * (i + 2)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    counts = un.outcomes(s, 33, 6).groupBy(score(F.col("numbers")).alias("score")).agg(F.count(F.lit(1)).alias("c"))
    asked = br.draws(s, d).select("k", score(F.array_sort(F.col("front").cast("array<bigint>"))).alias("score"))
    return un.midrank_quantile(counts, asked).select("k", "score", "quantile")


_add(
    "e4_midrank",
    f"WITH {DRAWS}, {UNIVERSE}, c AS (SELECT 2*a*a + 3*b*b + 4*c*c + 5*d*d + 6*e*e + 7*f*f AS score, count(*) AS c FROM u GROUP BY 1), q AS (SELECT score, round((2 * sum(c) OVER (ORDER BY score) - c) / (2 * sum(c) OVER ()), 9) AS quantile FROM c), "
    "x AS (SELECT k, (SELECT sum(front[i] * front[i] * (i + 1)) FROM (SELECT unnest(range(1, 7)) AS i))::BIGINT AS score FROM draws) SELECT k, score, quantile FROM x JOIN q USING (score)",
    _midrank,
)
_add(
    "e15_union",
    f"WITH {TICKETS}, {UNIVERSE}, m AS (SELECT list_sum([1::BIGINT << x FOR x IN main])::BIGINT AS m FROM tickets GROUP BY 1), um AS (SELECT (1::BIGINT << a) + (1::BIGINT << b) + (1::BIGINT << c) + (1::BIGINT << d) + (1::BIGINT << e) + (1::BIGINT << f) AS m FROM u), "
    "r AS (SELECT count(*) AS reached FROM um WHERE EXISTS (SELECT 1 FROM m WHERE bit_count(m.m & um.m) >= 4)), n AS (SELECT count(*) AS n FROM tickets) SELECT 1107568::BIGINT AS outcomes, reached, n * 5428 AS wins, round(reached / 1107568, 9) AS chance, round(n * 5428 / 1107568, 9) AS expected FROM r, n",
    lambda s, d: un.exact_union(br.tickets(s, d), 33, 6, 4),
)

_RUN = "list_max([len(string_split(r, 'x')) - 1 FOR r IN string_split(array_to_string([CASE WHEN i > 1 AND front[i] = front[i - 1] + 1 THEN 'x' ELSE '.x' END FOR i IN range(1, 7)], ''), '.')])"
_FEATURES = {
    "winners": "1", "total": "list_sum(front)", "span": "front[6] - front[1]", "odd": "len([x FOR x IN front IF x % 2 = 1])", "pairs": "len([1 FOR i IN [1, 2, 3, 4, 5] IF front[i + 1] - front[i] = 1])", "low": "len([x FOR x IN front IF x <= 16])",
    "longest_run": _RUN, "share12": "round(len([x FOR x IN front IF x <= 12]) / 6, 6)", "share31": "round(len([x FOR x IN front IF x <= 31]) / 6, 6)",
    "complexity": "len(list_distinct(flatten([[front[j] - front[i] FOR j IN [1, 2, 3, 4, 5, 6] IF j > i] FOR i IN [1, 2, 3, 4, 5, 6]]))) - 5",
}
_add(
    "e5_fits",
    f"WITH {DRAWS}, o AS (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord FROM draws WHERE sales > 0), c AS (SELECT lottery, unnest(range({MIN_TRAIN + 1}, max(ord) + 1, {STEP})) AS cut FROM o GROUP BY 1), "
    f"x AS (SELECT lottery, ord, first_winners AS y, unnest([{', '.join(f'CAST({e} AS DOUBLE)' for e in _FEATURES.values())}]) AS x, unnest([{', '.join(repr(n) for n in _FEATURES)}]) AS feature FROM o), "
    f"b AS (SELECT lottery, feature, ord, sum(y * x) OVER (PARTITION BY lottery, feature ORDER BY ord) AS m FROM x) SELECT c.lottery, cut, feature, round(m, 3) AS moment FROM c JOIN b ON b.lottery = c.lottery AND b.ord = c.cut - 1",
    lambda s, d: wf.walk_forward_fits(br.draws(s, d), MIN_TRAIN, STEP).withColumn("moment", F.round("moment", 3)),
)
_add("e5_quantiles", "", lambda s, d: wf.walk_forward_quantiles(br.draws(s, d), MIN_TRAIN, STEP))
_add("e5_test", "", lambda s, d: wf.quantile_test(wf.walk_forward_quantiles(br.draws(s, d), MIN_TRAIN, STEP), BLOCK))
_add("e3_validation", "", lambda s, d: wf.cross_validation(wf.shape_frame(br.draws(s, d)), len(un.SHAPES)))
_add("e10_drift", "", lambda s, d: wf.halves_drift(wf.shape_frame(br.draws(s, d)), len(un.SHAPES)))

_add(
    "e7_statistics",
    f"WITH {SERIES}, x AS (SELECT lottery, p AS position, digits[p + 1] AS digit, t + 1 AS tier, [winners1, winners2][t + 1] AS w FROM series, (SELECT unnest(range(0, 5)) AS p), (SELECT unnest([0, 1]) AS t)) SELECT lottery, position, digit, tier, count(*) AS draws, sum(w)::BIGINT AS winners FROM x GROUP BY ALL",
    lambda s, d: lk.heat_statistics(br.series(s, d), ["winners1", "winners2"], 5, 10),
)
#: Of every seventh draw the sales count as unknown.
_gaps = lambda s, d: br.series(s, d).withColumn("sales", F.when(F.col("k") % 7 != 0, F.col("sales")))
_add(
    "e7_score",
    f"WITH {DRAWS}, g AS (SELECT DISTINCT lottery FROM draws) SELECT lottery, p AS position, 1.0 AS whole, 0.0 AS score FROM g, (SELECT unnest(range(0, 5)) AS p)",
    lambda s, d: lk.position_heat_poisson(_gaps(s, d), ["winners1", "winners2"]).groupBy("lottery", "position").agg(F.round(F.sum("share"), 6).alias("whole"), F.abs(F.round(F.max(F.abs("score")), 3)).alias("score")),
)
_add("e7_heat", "", lambda s, d: lk.position_heat_poisson(_gaps(s, d), ["winners1", "winners2"]))

CAP = 5_900_000.0
_add(
    "e19_sums",
    f"WITH {SERIES}, o AS (SELECT *, lag(pool) OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS before FROM series), x AS (SELECT lottery, prize1 >= {CAP} AS capped, round(winners1 * prize1 / before, 9) AS x FROM o WHERE winners1 > 0 AND before > 0) SELECT lottery, count(*) FILTER (NOT capped) AS uncapped, count(*) FILTER (capped) AS capped, round(sum(ln(x)) FILTER (NOT capped), 6) AS s1, round(sum(ln(x) * ln(x)) FILTER (NOT capped), 6) AS s2 FROM x WHERE x > 0 GROUP BY 1",
    lambda s, d: lk.censored_sums(lk.paid_shares(br.series(s, d), CAP)).withColumns({"s1": F.round("s1", 6), "s2": F.round("s2", 6)}),
)
_add("e19_fit", "", lambda s, d: lk.pool_shares(br.series(s, d), CAP, BLOCK))


# permutations and bootstraps; SQL holds the observed values, tests the replicates
_BONUS = lambda s, d: with_order(br.draws(s, d)).select("lottery", "ord", F.element_at("back", 1).alias("x"))
_add("t3_runs_null", "", lambda s, d: rs.run_test(_BONUS(s, d)))
_add(
    "t3_observed",
    f"WITH {DRAWS}{ORD}, a AS (SELECT lottery, ord, CASE WHEN back[1] = lag(back[1]) OVER (PARTITION BY lottery ORDER BY ord) THEN 0 ELSE 1 END AS new FROM n), b AS (SELECT lottery, sum(new) OVER (PARTITION BY lottery ORDER BY ord) AS run FROM a) SELECT lottery, max(c)::DOUBLE AS value FROM (SELECT lottery, run, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1",
    lambda s, d: rs.observed_run(_BONUS(s, d)),
)


def _signs(s, d):
    draws = br.draws(s, d)
    return with_order(draws).join(F.broadcast(medians(draws, ["lottery"], "sales")), "lottery").select("lottery", "ord", F.when(F.col("sales") > F.col("middle"), 1).otherwise(-1).alias("x"))  # one row a game


_add("t5_cusum_null", "", lambda s, d: rs.cusum_test(_signs(s, d)))
_add(
    "t5_observed",
    f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord, CASE WHEN sales > median(sales) OVER (PARTITION BY lottery) THEN 1 ELSE -1 END AS x FROM n) SELECT lottery, max(abs(c))::DOUBLE AS value FROM (SELECT lottery, sum(x) OVER (PARTITION BY lottery ORDER BY ord) AS c FROM x) GROUP BY 1",
    lambda s, d: rs.observed_reach(_signs(s, d)),
)
_add("b24_interval", "", lambda s, d: bt.trial_interval(settle(br.tickets(s, d), br.draws(s, d)), "A", "N", BLOCK))

_add(
    "t16_apart",
    f"WITH {DRAWS}{ORD}, r AS (SELECT lottery, ord, {_RUN} >= 2 AS x FROM n), w AS (SELECT lottery, ord, sum(x::INT) OVER (PARTITION BY lottery ORDER BY ord ROWS 14 PRECEDING)::BIGINT AS n FROM r QUALIFY ord >= 15), q AS (SELECT lottery, quantile_cont(n, 0.95) AS a, quantile_cont(n, 0.99) AS b FROM w GROUP BY 1), c AS (SELECT lottery, ord, n, n > b AS severe FROM w JOIN q USING (lottery) WHERE n > greatest(a, 4)), "
    "l AS (SELECT lottery, list_reduce(list([ord] ORDER BY n DESC, ord), lambda a, b: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda o: abs(o - b[1]) < 15)) = 0 THEN list_concat(a, b) ELSE a END) AS taken FROM c GROUP BY 1) SELECT c.lottery, ord, n, severe, list_position(taken, ord)::BIGINT AS place FROM c JOIN l USING (lottery) WHERE list_contains(taken, ord)",
    lambda s, d: sg.best_clusters(sg.run_clusters(br.draws(s, d), scalar.shape_features(F.col("front"))["longest_run"])),
)

GAME = {f"g{i}": ht.Game({"front": "h", "back": "j"}, choose={"front": 6, "back": 1}) for i in range(1, 5)}
_FOUND = lambda s, d, text, lottery=None: settle(br.tickets(s, d), br.draws(s, d)).where(F.col("grade").isNotNull()).where(ht.condition_of_games(GAME, text, lottery)).groupBy("lottery", "grade").agg(F.count(F.lit(1)).alias("tickets"), F.sum("amount").cast("bigint").alias("money"))
_add("l6_zones", SETTLED + "SELECT lottery, grade, count(*) AS tickets, sum(amount)::BIGINT AS money FROM settled WHERE grade IS NOT NULL AND lottery = 'g2' AND h >= 2 AND j >= 1 GROUP BY 1, 2", lambda s, d: _FOUND(s, d, "front:2, back:1", "g2"))
_add("l6_total", SETTLED + "SELECT lottery, grade, count(*) AS tickets, sum(amount)::BIGINT AS money FROM settled WHERE grade IS NOT NULL AND h + j >= 3 GROUP BY 1, 2", lambda s, d: _FOUND(s, d, "total:3"))


def _picks(s, d):
    return se.strategy_hits(br.draws(s, d), SIZE, 6, {"hot30": 30, "hot100": 100}, "overdue")


_HOTS = lambda w: f"SELECT lottery, 'hot{w}' AS strategy, ord, num, hit, coalesce(sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS score FROM cells"
_OOS = f"""WITH {DRAWS}{CELLS}, s AS ({_HOTS(30)} UNION ALL {_HOTS(100)} UNION ALL SELECT lottery, 'overdue', ord, num, hit, ord - coalesce(max(CASE WHEN hit = 1 THEN ord END) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) FROM cells),
r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lottery, strategy, ord ORDER BY score DESC, num) <= 6), p AS (SELECT lottery, strategy, ord, sum(hit) AS hits FROM r GROUP BY ALL),
f AS (SELECT lottery, strategy, (ord - 101) // 60 AS fold, count(*) AS n, sum(hits)::BIGINT AS hits, sum(hits) FILTER ((ord - 101) % 60 < 30) AS a, sum(hits) FILTER ((ord - 101) % 60 >= 30) AS b FROM p WHERE ord > 100 GROUP BY ALL HAVING count(*) = 60),
x AS (SELECT lottery, strategy, fold, n, hits, round((a - 30 * 36 / 33) * (a - 30 * 36 / 33) / (30 * (36 / 33 * 27 / 33 * 27 / 32)) + (b - 30 * 36 / 33) * (b - 30 * 36 / 33) / (30 * (36 / 33 * 27 / 33 * 27 / 32)), 9) AS chi2 FROM f), y AS (SELECT *, round(exp(-chi2 / 2), 9) AS p FROM x) """
_add("b17_oos", _OOS + "SELECT * FROM y", lambda s, d: se.oos_backtest(_picks(s, d), SIZE, 6, 100, 60))
_add(
    "t30_adjusted",
    _OOS + ", z AS (SELECT *, count(*) OVER (PARTITION BY lottery) AS m, p * count(*) OVER (PARTITION BY lottery) / row_number() OVER (PARTITION BY lottery ORDER BY p, strategy, fold) AS raw FROM y) SELECT lottery, strategy, fold, n, hits, chi2, p, round(least(1.0, min(raw) OVER (PARTITION BY lottery ORDER BY p DESC, strategy DESC, fold DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted, round(least(1.0, p * m), 9) AS bonferroni, round(1 - pow(1 - p, m), 9) AS sidak FROM z",
    lambda s, d: st.adjusted(se.oos_backtest(_picks(s, d), SIZE, 6, 100, 60), "p", ["lottery"], ["strategy", "fold"]),
)


def _lateral(s, d):
    table_functions.register(s)
    br.tickets(s, d).select("main").distinct().createOrReplaceTempView("_frozen_tickets")
    return s.sql("SELECT element_at(subset, 1) AS first, count(DISTINCT subset) AS subsets, count(*) AS held FROM _frozen_tickets, LATERAL t_subsets(main, 3) GROUP BY 1")


_add(
    "r5_subsets",
    f"WITH {TICKETS}, m AS (SELECT DISTINCT main FROM tickets), t AS (SELECT main[i] AS a, main[j] AS b, main[l] AS c FROM m, (SELECT unnest(range(1, 7)) AS i), (SELECT unnest(range(1, 7)) AS j), (SELECT unnest(range(1, 7)) AS l) WHERE i < j AND j < l) SELECT a AS first, count(DISTINCT [a, b, c]) AS subsets, count(*) AS held FROM t GROUP BY 1",
    _lateral,
)
