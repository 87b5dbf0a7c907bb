"""Queries on features, models, shared prizes and event streams (run as batches) with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import backtests as bt
from ..operators import features as ft
from ..operators import models as md
from ..operators import prizes as pz
from ..operators.settle import settle
from ..streaming import jobs
from . import bridge as br
from .bridge import DRAWS, SERIES, TICKETS
from .sql_parts import CELLS, SETTLED, SIZE

QUERIES, ORACLES = {}, {}
W = 100


def _add(name, sql, make):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


PAST = f"ps AS (SELECT *, coalesce(sum(hit) OVER (p ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING), 0) AS c, coalesce(sum(hit) OVER (p ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS c10, coalesce(sum(hit) OVER (p ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS c30, coalesce(sum(hit) OVER (p ROWS BETWEEN {W // 2} PRECEDING AND 1 PRECEDING), 0) AS ch, ord - 1 - coalesce(max(CASE WHEN hit = 1 THEN ord END) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS om FROM cells WINDOW p AS (PARTITION BY lottery, num ORDER BY ord))"
V1 = f"list(round(c / {W}, 6) ORDER BY num) AS freq, list(round(least(om, {W}) / {W}, 6) ORDER BY num) AS gap, [round(sum(c) FILTER (num % 2 = 1) / sum(c), 6), round(sum(c) FILTER (num <= 16) / sum(c), 6), round(sum(c) FILTER (num <= 11) / sum(c), 6), round(sum(c) FILTER (num > 11 AND num <= 22) / sum(c), 6), round(sum(c) FILTER (num > 22) / sum(c), 6)] AS shares, list(hit ORDER BY num) AS label"
_add("w3_features", f"WITH {DRAWS}{CELLS}, {PAST} SELECT lottery, ord, {V1} FROM ps WHERE ord > {W} GROUP BY 1, 2", lambda s, d: ft.feature_matrix_v1(br.draws(s, d), SIZE, W))
_add("w4_features", f"WITH {DRAWS}{CELLS}, {PAST} SELECT lottery, ord, {V1}, list(round(c10 / 10, 6) ORDER BY num) AS freq10, list(round(c30 / 30, 6) ORDER BY num) AS freq30, list(round((2 * ch - c) / {W}, 6) ORDER BY num) AS slope FROM ps WHERE ord > {W} GROUP BY 1, 2", lambda s, d: ft.feature_matrix_v2(br.draws(s, d), SIZE, W))
_add(
    "w6_as_of",
    f"WITH {SERIES}, o AS (SELECT lottery, pool, sales, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord FROM series) SELECT lottery, ord, lag(pool) OVER (PARTITION BY lottery ORDER BY ord) AS pool_before, round(quantile_cont(sales, 0.5) FILTER (sales > 0) OVER w, 4) AS median, round(quantile_cont(sales, 0.1) FILTER (sales > 0) OVER w, 4) AS p10, round(quantile_cont(sales, 0.9) FILTER (sales > 0) OVER w, 4) AS p90 FROM o WINDOW w AS (PARTITION BY lottery ORDER BY ord ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)",
    lambda s, d: ft.pit_view(br.series(s, d)),
)
_add(
    "b25_gap",
    f"WITH {DRAWS}{CELLS}, {PAST}, r AS (SELECT * FROM ps WHERE ord > {W} QUALIFY row_number() OVER (PARTITION BY lottery, ord ORDER BY c DESC, num) <= 6), p AS (SELECT lottery, ord, sum(c) / {W} AS i, sum(hit) AS o FROM r GROUP BY 1, 2), g AS (SELECT lottery, count(*) AS n, avg(i) AS a, avg(o) AS b FROM p GROUP BY 1) SELECT lottery, n, round(a, 6) AS inside, round(b, 6) AS outside, round((a - b) / (a + b), 6) AS gap FROM g",
    lambda s, d: ft.train_test_gap(br.draws(s, d), SIZE, W, 6),
)
_add(
    "e19_pool",
    f"WITH {SERIES}, o AS (SELECT lottery, winners1, prize1, lag(pool) OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS before FROM series) SELECT lottery, count(*) AS n, round(avg((prize1 >= 5900000)::INT), 6) AS at_cap, round(median(round(winners1 * prize1 / before, 9)), 6) AS paid FROM o WHERE winners1 > 0 AND before > 0 GROUP BY 1",
    lambda s, d: ft.pool_calibration(br.series(s, d), 5_900_000),
)
P1 = 1 / 17_721_088
# without a cap the shared prize has the closed form pool * (1 - exp(-mu)) / mu
_add("e8_shared", f"WITH {DRAWS}, m AS (SELECT DISTINCT lottery, 1 + floor(sales / 1000000) AS mu FROM draws) SELECT lottery, mu::DOUBLE AS mu, round(1000 * (1 - exp(-mu)) / mu, 6) AS prize FROM m", lambda s, d: br.draws(s, d).select("lottery", F.expr("cast(1 + sales div 1000000 as double)").alias("mu")).distinct().select("lottery", "mu", F.round(special.share_expected(F.lit(1000.0), "mu", F.lit(1e12)), 6).alias("prize")))


def _nominal(s, d):
    keys = br.draws(s, d).select("k", F.expr("(issue_year + 15 + k % 20) * 100000 + issue_seq % 150").alias("key"))
    table = pz.double_rules(s).withColumn("assumed", F.when(F.col("grade") == 1, 5_000_000).when(F.col("grade") == 2, 100_000).otherwise(10_000))
    ev = pz.nominal_ev(pz.grade_probabilities(s, {"double": (35, 5, 5, 12, 2, 2)}), table, 2.0)
    versions = F.broadcast(table.select("version", "from_key", "to_key").distinct())  # one row a version
    return keys.join(versions, (F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("to_key"))).groupBy("version").agg(F.count(F.lit(1)).alias("draws")).join(ev, "version")


def _chances() -> str:
    from math import comb

    cell = lambda h, j: comb(5, h) * comb(30, 5 - h) / comb(35, 5) * comb(2, j) * comb(10, 2 - j) / comb(12, 2)
    rows = []
    for i, (name, (y, q), grades, fixed, _) in enumerate(pz.DOUBLE_VERSIONS):
        to = pz.DOUBLE_VERSIONS[i + 1][1] if i + 1 < len(pz.DOUBLE_VERSIONS) else (9999, 0)
        rows += [f"('{name}', {y * 100_000 + q}, {to[0] * 100_000 + to[1]}, {cell(h, j)!r}, {fixed.get(g, {1: 5_000_000, 2: 100_000}.get(g, 10_000))})" for g, cells in grades.items() for h, j in cells]
    return ", ".join(rows)


_add("e11_nominal", f"WITH {DRAWS}, v(version, a, b, p, amount) AS (VALUES {_chances()}), e AS (SELECT version, a, b, round(sum(p), 9) AS \"any\", round(sum(p * amount) - 2.0, 6) AS ev FROM v GROUP BY 1, 2, 3) SELECT version, count(*) AS draws, \"any\", ev FROM draws JOIN e ON (issue_year + 15 + k % 20) * 100000 + issue_seq % 150 >= a AND (issue_year + 15 + k % 20) * 100000 + issue_seq % 150 < b GROUP BY ALL", _nominal)

TEN = 0.0078
_add(
    "b13_gate",
    SETTLED + f", g AS (SELECT e.draw_k, CASE WHEN issue_year < 1998 THEN 'early' ELSE 'late' END AS version, count(*) AS K, count(*) FILTER (amount >= 10) AS reached FROM ev e JOIN draws d ON d.k = e.draw_k GROUP BY 1, 2), p AS (SELECT *, CASE version WHEN 'early' THEN {TEN!r} ELSE {TEN * 1.1!r} END AS p FROM g), s AS (SELECT version, count(*) AS draws, count(*) FILTER (reached > 0) AS hit, avg(K * p) AS kp, avg(1 - pow(1 - p, K)) AS base FROM p GROUP BY 1) SELECT version, draws, hit, round(hit / draws, 6) AS share, round(sqrt(hit / draws * (1 - hit / draws) / draws), 6) AS se, round(kp, 6) AS kp, round(base, 6) AS baseline, round(hit / draws / least(1, kp), 6) AS efficiency FROM s",
    lambda s, d: bt.gate_series(settle(br.tickets(s, d), br.draws(s, d)).where("status = 'evaluated'").groupBy("draw_k").agg(F.count(F.lit(1)).alias("K"), F.count(F.when(F.col("amount") >= 10, 1)).alias("reached")).join(br.draws(s, d).select(F.col("k").alias("draw_k"), F.expr("if(issue_year < 1998, 'early', 'late')").alias("version")), "draw_k"), {"early": TEN, "late": TEN * 1.1}),
)
_add(
    "b24_trials",
    SETTLED + ", g AS (SELECT lottery, draw_k, avg(amount) FILTER (strategy = 'A') AS x, avg(amount) FILTER (strategy = 'N') AS y FROM ev GROUP BY 1, 2), t AS (SELECT lottery, count(*) AS draws, count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses, avg(x) AS mx, avg(y) AS my FROM g WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT lottery, draws, wins, losses, round(mx - my, 6) AS difference, round(wins * ln(1.5) + losses * ln(0.5), 6) AS log_wealth, abs(mx - my) <= 0.1 * greatest(mx, my) AS equivalent FROM t",
    lambda s, d: bt.trial_report(settle(br.tickets(s, d), br.draws(s, d)), "A", "N").drop("p"),
)
_add(
    "b30_edge",
    f"WITH {SERIES}, l AS (SELECT lottery, pool, sales / 2.0 * {P1!r} AS l FROM series WHERE sales > 0), x AS (SELECT lottery, pool * 0.7 * {P1!r} * ((1 - exp(-l * 0.7)) / (l * 0.7) - (1 - exp(-l * 1.4)) / (l * 1.4)) AS x FROM l) SELECT lottery, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x) / stddev(x), 6) AS d, round(avg((x > 0)::INT), 6) AS positive, round(max(x) / sum(x), 6) AS largest FROM x GROUP BY 1",
    lambda s, d: bt.ev_edge(br.series(s, d), 0.7, 1.4, P1, 0.7),
)

_add(
    "b6_positions",
    f"WITH {SERIES}, o AS (SELECT lottery, digits, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord FROM series), c AS (SELECT lottery, ord, p AS pos, digits[p + 1] AS x, lag(digits[p + 1]) OVER (PARTITION BY lottery, p ORDER BY ord) AS prev FROM o, (SELECT unnest(range(0, 5)) AS p)), g AS (SELECT lottery, pos, x, ord - lag(ord) OVER (PARTITION BY lottery, pos, x ORDER BY ord) AS gap FROM c), ag AS (SELECT lottery, pos, x, avg(gap) AS gap FROM g GROUP BY ALL), fr AS (SELECT lottery, pos, x, count(*) AS freq, max(ord) AS last FROM c GROUP BY ALL), nn AS (SELECT lottery, max(ord) AS n FROM o GROUP BY 1), nw AS (SELECT lottery, pos, arg_max(x, ord) AS now FROM c GROUP BY ALL), "
    "mv AS (SELECT c.lottery, c.pos, c.x, count(*) AS m FROM c JOIN nw ON nw.lottery = c.lottery AND nw.pos = c.pos AND nw.now = c.prev GROUP BY ALL), e AS (SELECT nw.lottery, nw.pos, v AS digit FROM nw, (SELECT unnest(range(0, 10)) AS v)), t AS (SELECT e.*, coalesce(freq, 0) AS freq, coalesce(m, 0) AS m, gap, nn.n - coalesce(last, 0) AS om FROM e JOIN nn USING (lottery) LEFT JOIN fr ON fr.lottery = e.lottery AND fr.pos = e.pos AND fr.x = e.digit LEFT JOIN mv ON mv.lottery = e.lottery AND mv.pos = e.pos AND mv.x = e.digit LEFT JOIN ag ON ag.lottery = e.lottery AND ag.pos = e.pos AND ag.x = e.digit), "
    "sc AS (SELECT lottery, pos, digit, round(0.6 * CASE WHEN sum(m) OVER p > 0 THEN (m + 0.5) / (sum(m) OVER p + 5) ELSE 0.1 END + 0.25 * CASE WHEN gap > 0 THEN least(1, om / gap) ELSE 0.5 END + 0.15 * (freq + lag(freq, 1, 0) OVER (PARTITION BY lottery, pos ORDER BY digit) + lead(freq, 1, 0) OVER (PARTITION BY lottery, pos ORDER BY digit)) / sum(freq) OVER p, 6) AS score FROM t WINDOW p AS (PARTITION BY lottery, pos)) SELECT *, row_number() OVER (PARTITION BY lottery, pos ORDER BY score DESC, digit) AS place FROM sc",
    lambda s, d: bt.rank_positions(br.series(s, d)),
)

_add(
    "e9_uplift",
    f"WITH {SERIES}, l AS (SELECT lottery, sales / 2.0 * {P1!r} AS l, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord, count(*) OVER (PARTITION BY lottery) AS n FROM series WHERE sales > 0), x AS (SELECT *, round((1 - exp(-l * 0.7)) / (l * 0.7) / ((1 - exp(-l * 1.4)) / (l * 1.4)), 9) AS x FROM l) SELECT lottery, count(*) AS n, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.5) FILTER (ord * 2 <= n), 6) AS first_half, round(quantile_cont(x, 0.5) FILTER (ord * 2 > n), 6) AS last_half FROM x GROUP BY 1",
    lambda s, d: bt.counterfactual_uplift(br.series(s, d), 0.7, 1.4, P1),
)


def _candidates(s, d):
    pools = br.series(s, d).groupBy("lottery").agg(F.max("pool").alias("pool"), F.max("sales").alias("sales"))
    return bt.score_candidates(br.tickets(s, d), pools, 1.5, P1, 0.7, 10_000_000.0, 50)


_add(
    "e14_candidates",
    f"WITH {SERIES}, {TICKETS}, p AS (SELECT lottery, max(pool) AS pool, max(sales) / 2.0 * {P1!r} AS lam FROM series GROUP BY 1), c AS (SELECT DISTINCT main, exp(1.5 * (len([x FOR x IN main IF x <= 12]) / 6 - 0.35)) AS f FROM tickets), e AS (SELECT lottery, array_to_string(main, '-') AS numbers, round({P1!r} * least(10000000.0, pool * 0.7 * (1 - exp(-lam * f)) / (lam * f)) - 2.0, 9) AS ev FROM c, p) SELECT lottery, row_number() OVER (PARTITION BY lottery ORDER BY ev DESC, numbers) AS place, numbers, ev FROM e QUALIFY place <= 50",
    lambda s, d: _candidates(s, d).drop("main"),
)
_add("e14_selected", "", lambda s, d: bt.select_topk(_candidates(s, d), 2, 10))

# models: no SQL
_add("e3_popularity", "", lambda s, d: md.per_game(md.popularity_frame(br.draws(s, d)), md.fit_popularity))
_add("e6_heat", "", lambda s, d: md.per_game(br.series(s, d), md.position_heat))
_add("e18_forecast", "", lambda s, d: md.per_game(md.sales_lags(br.draws(s, d)), md.forecast_sales))
_add("b22_numbers", "", lambda s, d: md.per_game(ft.number_cells(br.draws(s, d), SIZE, W), md.number_model))

# streams, run as batches
_add(
    "x2_settle",
    "SELECT p.event_id AS prediction_id, p.user_id AS key, p.ts AS made, r.ts AS drawn, r.value AS outcome, CASE WHEN r.event_id IS NULL THEN 'missed' ELSE 'evaluated' END AS status FROM (SELECT * FROM events WHERE event_type = 'signup') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON r.user_id = p.user_id AND r.ts >= p.ts AND r.ts <= p.ts + INTERVAL 6 HOUR",
    lambda s, d: jobs.settle_stream(_events(s, d).where("event_type = 'signup'").select(F.col("event_id").alias("prediction_id"), F.col("user_id").alias("key"), F.col("ts").alias("made")), _events(s, d).where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("drawn"), F.col("value").alias("outcome")), "6 hours"),
)
_add(
    "x3_sessions",
    "WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS st FROM events), y AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, b",
    lambda s, d: jobs.sessions(_events(s, d), "3600 seconds 1 microsecond"),
)
_add("x4_sliding", "WITH w AS (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * i AS start FROM events, (SELECT unnest(range(0, 7)) AS i)) SELECT start, count(*) AS n FROM w GROUP BY 1", lambda s, d: jobs.sliding_counts(_events(s, d)))
