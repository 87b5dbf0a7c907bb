"""Queries of the tests on draws with the SQL that their statistics are checked against (p-values are tested apart)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar, special
from ..operators import draw_stats as st
from ..operators import series as se
from ..operators import significance as sg
from ..operators.order import medians, with_order
from ..operators.settle import settle
from . import bridge as br
from .bridge import DRAWS, SERIES, WINNERS
from .sql_parts import CELLS, NUM, ORD, SETTLED, SIZE

QUERIES, ORACLES = {}, {}
#: Chances of the first two prizes of the game that the series stands for, and its prize table's chance of any prize.
P1, P2, ANY = 1 / 17_721_088, 15 / 17_721_088, 0.0671


def _add(name, sql, make):
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _run(front="front"):
    return scalar.shape_features(F.col(front))["longest_run"]


PAIRS = "pp AS (SELECT lottery, i, j, digits[i + 1] AS x, digits[j + 1] AS y, count(*) AS c FROM series, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j) WHERE i < j GROUP BY ALL), pm AS (SELECT *, sum(c) OVER (PARTITION BY lottery, i, j, x) AS cx, sum(c) OVER (PARTITION BY lottery, i, j, y) AS cy, sum(c) OVER (PARTITION BY lottery, i, j) AS n FROM pp)"
_add(
    "t8_same_rate",
    f"WITH {SERIES}, {PAIRS}, mx AS (SELECT DISTINCT lottery, i, j, x AS v, cx, n FROM pm), my AS (SELECT DISTINCT lottery, i, j, y AS v, cy FROM pm), e AS (SELECT lottery, i, j, sum(cx * cy / n / n) AS e FROM mx JOIN my USING (lottery, i, j, v) GROUP BY ALL), g AS (SELECT lottery, i, j, max(n)::BIGINT AS n, coalesce(sum(c) FILTER (x = y), 0)::BIGINT AS same FROM pm GROUP BY ALL), z AS (SELECT *, (same / n - e) / sqrt(e * (1 - e) / n) AS z FROM g JOIN e USING (lottery, i, j)) "
    "SELECT lottery, i, j, n, same, round(e, 6) AS expected, round(z, 5) AS z, abs(z) >= 3 AS practical FROM z",
    lambda s, d: sg.same_rate(br.series(s, d)).drop("p"),
)
_add("t9_independence", f"WITH {SERIES}, {PAIRS}, g AS (SELECT lottery, i, j, max(n)::BIGINT AS n, sum(c * c / (cx * cy)) AS s, count(DISTINCT x) AS r, count(DISTINCT y) AS k, min(cx) AS lx, min(cy) AS ly FROM pm GROUP BY ALL), c AS (SELECT *, n * (s - 1) AS chi FROM g WHERE r > 1 AND k > 1) SELECT lottery, i, j, n, round(chi, 5) AS chi2, (r - 1) * (k - 1) AS df, round(sqrt(chi / (n * (least(r, k) - 1))), 6) AS v, round(lx * ly / n, 5) AS least_expected FROM c", lambda s, d: sg.position_independence(br.series(s, d)).drop("p"))
T = special._NORMAL.inv_cdf(0.95**0.1)
_add("t10_diagonal", f"WITH {SERIES}, {PAIRS} SELECT lottery, i, j, round(max(c / n / (cx / n * (cy / n))), 6) AS gain, round(max((c / n + {T!r} * sqrt(cx / n * (cy / n) * (1 - cx / n * (cy / n)) / n)) / (cx / n * (cy / n))), 6) AS bound FROM pm WHERE x = y GROUP BY ALL", lambda s, d: sg.diagonal_gain(br.series(s, d), 10))

ROLL = "wc AS (SELECT lottery, ord, num, sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS {w} PRECEDING) AS c FROM cells)"
CRIT = special.chi2_quantile(0.99, SIZE - 1)
_add(
    "t12_sliding",
    f"WITH {DRAWS}{CELLS}, {ROLL.format(w=99)}, g AS (SELECT lottery, ord, sum(c) / 33 AS e, list(c ORDER BY num) AS l FROM wc WHERE ord >= 100 GROUP BY 1, 2), x AS (SELECT *, list_sum([(c - e) * (c - e) / e FOR c IN l]) AS chi, list_max([abs(c - e) FOR c IN l]) / greatest(e, 1) AS dev, [{{'k': -l[i], 'i': i}} FOR i IN range(1, 34) IF l[i] > e] AS hot, [{{'k': l[i], 'i': i}} FOR i IN range(1, 34) IF l[i] < e] AS cold FROM g) "
    f"SELECT lottery, ord, round(chi, 5) AS chi2, round(dev, 5) AS deviation, dev > 0.8 AS severe, array_to_string([a.i FOR a IN list_slice(list_sort(hot), 1, 3)], '-') AS hot, array_to_string([a.i FOR a IN list_slice(list_sort(cold), 1, 3)], '-') AS cold FROM x WHERE chi > {CRIT!r}",
    lambda s, d: sg.sliding_chi2(br.draws(s, d), SIZE, 100, 0.01),
)
_add(
    "t14_zones",
    f"WITH {DRAWS}{CELLS}, {ROLL.format(w=49)}, g AS (SELECT lottery, ord, [sum(c) FILTER (num < 11), sum(c) FILTER (num >= 11 AND num < 22), sum(c) FILTER (num >= 22)] AS p FROM wc WHERE ord >= 50 GROUP BY 1, 2), x AS (SELECT *, list_sum(p) / 3 AS e FROM g), y AS (SELECT *, list_max([abs(a - e) / greatest(e, 1) FOR a IN p]) AS dev, sqrt(list_sum([(a - e) * (a - e) / greatest(e, 1) FOR a IN p])) AS z FROM x) SELECT lottery, ord, array_to_string(p, '-') AS parts, round(dev, 5) AS deviation, round(z, 5) AS z, dev > 0.6 AS severe FROM y WHERE dev > 0.3 AND z > 2",
    lambda s, d: sg.zone_deviation(br.draws(s, d)),
)
RUN = "list_max([len(string_split(r, 'x')) - 1 FOR r IN string_split(array_to_string([CASE WHEN i > 1 AND front[i] = front[i - 1] + 1 THEN 'x' ELSE '.x' END FOR i IN range(1, 7)], ''), '.')])"
_add("t16_extremes", f"WITH {DRAWS}, r AS (SELECT *, {RUN} AS run FROM draws), m AS (SELECT lottery, avg(run) AS a, stddev_pop(run) AS s FROM r GROUP BY 1) SELECT lottery, issue_year, issue_seq, run, row_number() OVER (PARTITION BY lottery ORDER BY run DESC, issue_year, issue_seq) AS place, round((run - a) / s, 5) AS z FROM r JOIN m USING (lottery) WHERE run >= 3 QUALIFY place <= 12", lambda s, d: sg.extreme_runs(br.draws(s, d), _run(), 3, 12))
_add("t16_clusters", f"WITH {DRAWS}{ORD}, r AS (SELECT lottery, ord, {RUN} >= 2 AS x FROM n), w AS (SELECT lottery, ord, sum(x::INT) OVER (PARTITION BY lottery ORDER BY ord ROWS 14 PRECEDING)::BIGINT AS n FROM r QUALIFY ord >= 15), q AS (SELECT lottery, quantile_cont(n, 0.95) AS a, quantile_cont(n, 0.99) AS b FROM w GROUP BY 1) SELECT lottery, ord, n, n > b AS severe FROM w JOIN q USING (lottery) WHERE n > greatest(a, 4)", lambda s, d: sg.run_clusters(br.draws(s, d), _run()))
_add("t17_shapes", f"WITH {DRAWS}, x AS (SELECT *, front[6] - front[1] AS span FROM draws), m AS (SELECT lottery, avg(span) AS a, stddev_pop(span) AS s FROM x GROUP BY 1), z AS (SELECT *, (span - a) / s AS z FROM x JOIN m USING (lottery)) SELECT lottery, issue_year, issue_seq, span, list_min([front[i + 1] - front[i] for i in [1, 2, 3, 4, 5]]) AS min_gap, list_max([front[i + 1] - front[i] for i in [1, 2, 3, 4, 5]]) AS max_gap, round(z, 5) AS z, CASE WHEN z < 0 THEN 'clustered' ELSE 'spread' END AS shape FROM z WHERE abs(z) > 1.6", lambda s, d: sg.shape_anomaly(br.draws(s, d), 1.6))
_add("t18_periods", f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord, len([1 for i in [1, 2, 3, 4, 5] if front[i + 1] - front[i] = 1]) AS x FROM n), m AS (SELECT lottery, avg(x) AS m, count(*) AS n FROM x GROUP BY 1), y AS (SELECT x.lottery, ord, x - m AS x, m.n FROM x JOIN m ON m.lottery = x.lottery), ss AS (SELECT lottery, max(n) AS n, sum(x * x) AS ss FROM y GROUP BY 1), c AS (SELECT a.lottery, l.lag, sum(a.x * b.x) AS c FROM y a, (SELECT unnest(range(1, 31)) AS lag) l, y b WHERE a.lottery = b.lottery AND b.ord = a.ord - l.lag GROUP BY ALL) SELECT c.lottery, lag, round(c / (n - lag) / ss, 9) AS r FROM c JOIN ss USING (lottery)", lambda s, d: sg.periodicity(br.draws(s, d), scalar.shape_features(F.col("front"))["pairs"]))
_add("t18_regular", f"WITH {DRAWS}{NUM}, g AS (SELECT lottery, num, ord - lag(ord) OVER (PARTITION BY lottery, num ORDER BY ord) AS gap FROM num), a AS (SELECT lottery, num, count(gap) AS gaps, avg(gap) AS m, stddev_pop(gap) AS s FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT lottery, num, gaps, round(m, 6) AS mean, round(s / m, 6) AS cv, m >= 8 AND s / m < 0.25 AS regular FROM a", lambda s, d: sg.regular_numbers(st.numbered(br.draws(s, d))))
_add(
    "t19_change",
    f"WITH {DRAWS}{ORD}, v AS (SELECT unnest(range(1, 17)) AS v), t AS (SELECT lottery, back[1] AS v, count(*) AS t FROM n GROUP BY 1, 2), m AS (SELECT lottery, count(*) AS n FROM n GROUP BY 1), f AS (SELECT n.lottery, n.ord, t.v, t.t, sum((n.back[1] = t.v)::INT) OVER (PARTITION BY n.lottery, t.v ORDER BY n.ord) AS f FROM n JOIN t ON t.lottery = n.lottery), "
    "c AS (SELECT f.lottery, ord, m.n, round(sum((f - ord * t / n) * (f - ord * t / n) * (n * n) / (t * ord * (n - ord))), 6) AS chi FROM f JOIN m ON m.lottery = f.lottery WHERE ord >= 100 AND ord <= n - 100 GROUP BY 1, 2, 3) SELECT lottery, ord AS split, n, round(chi, 5) AS chi2, round(sqrt(chi / n), 6) AS v, sqrt(chi / n) >= 0.1 AS practical FROM c QUALIFY row_number() OVER (PARTITION BY lottery ORDER BY chi DESC, ord) = 1",
    lambda s, d: sg.change_point(br.draws(s, d), 16, 100),
)
REPL = "SELECT {cols}, r, CASE WHEN r = 0 THEN lpad({o}::VARCHAR, 32, '0') ELSE md5('7:' || r || ':' || {o}) END AS turn FROM {t}, (SELECT unnest(range(0, {n})) AS r)"
NULLS = "obs AS (SELECT lottery, max(v) FILTER (r = 0) AS observed, count(*) FILTER (r > 0) AS replicates, quantile_cont(v, 0.95) FILTER (r > 0) AS q95, quantile_cont(v, 0.99) FILTER (r > 0) AS q99 FROM stat GROUP BY 1), rea AS (SELECT lottery, count(*) FILTER (r > 0 AND v >= observed) AS reached FROM stat JOIN obs USING (lottery) GROUP BY 1), res AS (SELECT lottery, observed, replicates, reached, round((reached + 1) / (replicates + 1), 6) AS p, round(q95, 6) AS q95, round(q99, 6) AS q99 FROM obs JOIN rea USING (lottery)) "
_add(
    "t3_longest_run",
    f"WITH {DRAWS}{ORD}, s AS (SELECT lottery, ord, back[1] AS x FROM n), rp AS ({REPL.format(cols='lottery, x', o='ord', t='s', n=40)}), a AS (SELECT *, CASE WHEN x = lag(x) OVER w THEN 0 ELSE 1 END AS new FROM rp WINDOW w AS (PARTITION BY lottery, r ORDER BY turn)), b AS (SELECT *, sum(new) OVER (PARTITION BY lottery, r ORDER BY turn) AS run FROM a), c AS (SELECT lottery, r, run, count(*) AS n FROM b GROUP BY ALL), stat AS (SELECT lottery, r, max(n) AS v FROM c GROUP BY ALL), {NULLS} SELECT *, observed > q99 AS out_of_gate FROM res",
    lambda s, d: sg.longest_run(br.draws(s, d), 39),
)
_add(
    "t5_cusum",
    f"WITH {DRAWS}{ORD}, s AS (SELECT lottery, ord, CASE WHEN sales > median(sales) OVER (PARTITION BY lottery) THEN 1 ELSE -1 END AS x FROM n), rp AS ({REPL.format(cols='lottery, x', o='ord', t='s', n=40)}), a AS (SELECT lottery, r, abs(sum(x) OVER (PARTITION BY lottery, r ORDER BY turn)) AS c FROM rp), stat AS (SELECT lottery, r, max(c)::BIGINT AS v FROM a GROUP BY ALL), {NULLS} SELECT * FROM res",
    lambda s, d: sg.cusum(br.draws(s, d), medians(br.draws(s, d), ["lottery"], "sales"), 39),
)
_add(
    "t20_drift",
    f"WITH {DRAWS}, s AS (SELECT lottery, front, row_number() OVER (PARTITION BY lottery ORDER BY issue_year DESC, issue_seq DESC) AS age FROM draws QUALIFY age <= 180), rp AS ({REPL.format(cols='lottery, front', o='age', t='s', n=100)}), a AS (SELECT *, row_number() OVER (PARTITION BY lottery, r ORDER BY turn) <= 30 AS new FROM rp), e AS (SELECT lottery, r, new, unnest(front) AS num FROM a), c AS (SELECT lottery, r, num, count(*) FILTER (new) AS a, count(*) FILTER (NOT new) AS b FROM e GROUP BY ALL), "
    f"p AS (SELECT *, a / sum(a) OVER (PARTITION BY lottery, r) AS p, b / sum(b) OVER (PARTITION BY lottery, r) AS q FROM c), stat AS (SELECT lottery, r, round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS v FROM p GROUP BY ALL), {NULLS} SELECT *, p <= 0.05 AND observed >= 1.25 * q95 AS alarm FROM res",
    lambda s, d: sg.js_drift(br.draws(s, d)),
)
H = lambda cols: f"(SELECT lottery, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT lottery, {cols}, count(*) AS c FROM x GROUP BY ALL) GROUP BY lottery)"
_add(
    "t21_information",
    f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord, back[1] AS x0, lag(back[1], 1) OVER w AS x1, lag(back[1], 2) OVER w AS x2, lag(back[1], 3) OVER w AS x3 FROM n WINDOW w AS (PARTITION BY lottery ORDER BY ord) QUALIFY x3 IS NOT NULL), "
    + f"u AS (SELECT 1 AS lag, lottery, h FROM {H('x0')} UNION ALL SELECT 1, lottery, h FROM {H('x1')} UNION ALL SELECT 1, lottery, -h FROM {H('x0, x1')}"
    + "".join(f" UNION ALL SELECT {k}, lottery, h FROM {H('x0, x1')} UNION ALL SELECT {k}, lottery, h FROM {H(f'x{k}, x1')} UNION ALL SELECT {k}, lottery, -h FROM {H('x1')} UNION ALL SELECT {k}, lottery, -h FROM {H(f'x0, x1, x{k}')}" for k in (2, 3))
    + ") SELECT lottery, lag, round(sum(h), 6) AS nats FROM u GROUP BY ALL",
    lambda s, d: sg.mutual_information(br.draws(s, d), 3),
)
p0, eps = 6 / 33, 1e-3
_add(
    "t22_evidence",
    f"WITH {DRAWS}{CELLS}, q AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM cells), l AS (SELECT lottery, ord, num, CASE WHEN ord - 1 >= 200 THEN ln(1 + greatest({-(1 - eps) / (1 - p0)!r}, least({(1 - eps) / p0!r}, (c / (ord - 1) - {p0!r}) * {0.3 / (p0 * (1 - p0))!r})) * (hit - {p0!r})) ELSE 0 END AS g FROM q), "
    f"k AS (SELECT lottery, ord, sum(g) OVER (PARTITION BY lottery, num ORDER BY ord) AS lw FROM l), w AS (SELECT lottery, ord, ln(sum(exp(lw)) / 33) AS w FROM k GROUP BY 1, 2) SELECT lottery, round(arg_max(w, ord), 5) AS last, round(max(w), 5) AS most, min(ord) FILTER (w >= {math.log(20)!r}) AS crossed FROM w GROUP BY 1",
    lambda s, d: sg.e_process(br.draws(s, d), SIZE, 6),
)
_add("t23_signs", f"WITH {SERIES}, g AS (SELECT lottery, count(*) FILTER (winners1 * 16 > winners2) AS wins, count(*) FILTER (winners1 * 16 < winners2) AS losses FROM series GROUP BY 1) SELECT lottery, wins, losses, round(wins * ln(1.5) + losses * ln(0.5), 6) AS log_wealth FROM g", lambda s, d: sg.sign_evidence(br.series(s, d).select("lottery", (F.col("winners1") * 16 - F.col("winners2")).alias("difference"))).drop("p"))
POPULAR = "len([1 for x in front if x <= 12]) >= 3"
_add(
    "t24_popular",
    f"WITH {DRAWS}, x AS (SELECT lottery, {POPULAR} AS f, first_winners / (sales / 1e8) AS v FROM draws WHERE sales > 0), r AS (SELECT *, rank() OVER (PARTITION BY lottery ORDER BY v) + (count(*) OVER (PARTITION BY lottery, v) - 1) / 2 AS rk, count(*) OVER (PARTITION BY lottery, v) AS t FROM x), g AS (SELECT lottery, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(rk) FILTER (f) AS r, sum(t * t - 1) AS ties, avg(v) FILTER (f) AS a, avg(v) FILTER (NOT f) AS b FROM r GROUP BY 1), u AS (SELECT *, n1 + n2 AS n, r - n1 * (n1 + 1) / 2 AS u FROM g) "
    "SELECT lottery, n1, n2, round(u, 1) AS u, round((u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 5) AS z, round(a, 6) AS mean1, round(b, 6) AS mean2 FROM u",
    lambda s, d: sg.mann_whitney(br.draws(s, d).where("sales > 0").select("lottery", (F.size(F.filter("front", lambda x: x <= 12)) >= 3).alias("popular"), (F.col("first_winners") / (F.col("sales") / 1e8)).alias("v")), "v", "popular").drop("p"),
)
RK = "rank() OVER (PARTITION BY lottery ORDER BY {c}) + (count(*) OVER (PARTITION BY lottery, {c}) - 1) / 2"
_add("t25_spearman", f"WITH {DRAWS}, r AS (SELECT lottery, {RK.format(c='sales')} AS a, {RK.format(c='first_winners')} AS b FROM draws), g AS (SELECT lottery, count(*) AS n, corr(a, b) AS r FROM r GROUP BY 1) SELECT lottery, n, round(r, 6) AS rho, round(r * sqrt((n - 2) / (1 - r * r)), 4) AS t FROM g", lambda s, d: sg.spearman(br.draws(s, d), "sales", "first_winners").drop("p"))
_add("t25_fit", f"WITH {WINNERS}, g AS (SELECT lottery, region, sum(winners) AS w, sum(sales) AS s FROM prize_regions GROUP BY 1, 2), e AS (SELECT *, sum(w) OVER (PARTITION BY lottery) * s / sum(s) OVER (PARTITION BY lottery) AS e FROM g) SELECT lottery, round(sum((w - e) * (w - e) / e), 5) AS chi2, count(*) - 1 AS df FROM e WHERE e > 0 GROUP BY 1", lambda s, d: sg.goodness_of_fit(br.prize_regions(s, d).groupBy("lottery", "region").agg(F.sum("winners").alias("w"), F.sum("sales").alias("s")), "w", "s", ["lottery"]).drop("p"))


def _boot(top: str, bottom: str, block: int = 20, B: int = 200, seed: int = 11) -> str:
    x = f"(r * 7919 + j * 104729 + {seed * 1_299_709}) % 2147483647"
    for _ in range(3):
        x = f"({x}) * 48271 % 2147483647"
    return (
        f"bs AS (SELECT lottery, row_number() OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS ord, count(*) OVER (PARTITION BY lottery) AS n, {top} AS a, {bottom} AS b FROM series), ring AS (SELECT lottery, ord, n, a, b FROM bs UNION ALL SELECT lottery, ord + n, n, a, b FROM bs WHERE ord < {block}), "
        f"bl AS (SELECT lottery, n, ord - 1 AS start, sum(a) OVER w AS a, sum(b) OVER w AS b FROM ring WINDOW w AS (PARTITION BY lottery ORDER BY ord ROWS BETWEEN CURRENT ROW AND {block - 1} FOLLOWING) QUALIFY ord <= n), "
        f"st AS (SELECT lottery, r, ({x}) % n AS start FROM (SELECT DISTINCT lottery, n FROM bs), (SELECT unnest(range(1, {B + 1})) AS r), LATERAL (SELECT unnest(range(0, (n + {block - 1}) // {block})) AS j)), "
        "bb AS (SELECT lottery, r, sum(a) / sum(b) AS x FROM st JOIN bl USING (lottery, start) GROUP BY 1, 2), ci AS (SELECT lottery, round(stddev(x), 6) AS se, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM bb GROUP BY 1), wh AS (SELECT lottery, round(sum(a) / sum(b), 6) AS ratio FROM bs GROUP BY 1)"
    )


_add("p2_bootstrap", f"WITH {SERIES}, {_boot('winners1', 'winners2')} SELECT lottery, ratio, se, lo, hi FROM wh JOIN ci USING (lottery)", lambda s, d: sg.ratio_interval(br.series(s, d), "winners1", "winners2", 20))
_add("t26_ratio", f"WITH {SERIES}, {_boot('winners1', f'winners2 * {P1 / P2!r}')}, hf AS (SELECT lottery, round(sum(a) FILTER (ord * 2 <= n) / sum(b) FILTER (ord * 2 <= n), 6) AS first_half, round(sum(a) FILTER (ord * 2 > n) / sum(b) FILTER (ord * 2 > n), 6) AS second_half FROM bs GROUP BY 1) SELECT lottery, ratio, se, lo, hi, first_half, second_half, round((ratio - 1) / se, 3) AS z FROM wh JOIN ci USING (lottery) JOIN hf USING (lottery)", lambda s, d: sg.ratio_test(br.series(s, d), P1, P2))
_add("t26_years", f"WITH {SERIES} SELECT lottery, issue_year, count(*) AS draws, round(sum(winners1) / (sum(winners2) * {P1 / P2!r}), 6) AS ratio FROM series GROUP BY 1, 2 HAVING count(*) >= 20", lambda s, d: sg.ratio_by_year(br.series(s, d), P1, P2))
_add("t27_calibration", f"WITH {SERIES}, {_boot('sales / 2.0', f'winners2 / {P2!r}')} SELECT lottery, ratio AS factor, se, lo, hi, abs(ratio - 1) <= 4 * se AS holds, CASE WHEN abs(ratio - 1) <= 4 * se THEN 0.0 ELSE round(greatest(0, 2 * (ratio - 1)), 6) END AS addon FROM wh JOIN ci USING (lottery)", lambda s, d: sg.ticket_calibration(br.series(s, d), P2))
_add("t28_award", f"WITH {SERIES}, g AS (SELECT lottery, count(*) FILTER (award) AS awards, count(*) FILTER (NOT award) AS others, sum(winners1) FILTER (award) AS wa, sum(winners1) FILTER (NOT award) AS wo, sum(winners2 * {P1 / P2!r}) FILTER (award) AS ia, sum(winners2 * {P1 / P2!r}) FILTER (NOT award) AS io FROM series GROUP BY 1) SELECT lottery, awards, others, round(wa / ia, 6) AS in_award, round(wo / io, 6) AS otherwise, round((wa / ia - wo / io) / sqrt(wa / ia * wa / ia / wa + wo / io * wo / io / wo), 5) AS z FROM g", lambda s, d: sg.award_contrast(br.series(s, d), P1, P2))
SHIFT = 6 * (p0 * 1.1 - p0) ** 2 / p0 + 27 * ((6 - 6 * p0 * 1.1) / 27 - p0) ** 2 / p0
_add("t29_power", f"WITH {DRAWS} SELECT lottery, count(*) AS n, round(count(*) * {SHIFT!r}, 6) AS shift FROM draws GROUP BY 1", lambda s, d: sg.power(br.draws(s, d).groupBy("lottery").agg(F.count(F.lit(1)).alias("n")), SIZE, 6, 0.1).drop("power"))
MU, VAR = 36 / 33, 36 / 33 * 27 / 33 * 27 / 32


def _edges(s, d):
    scores = se.strategy_score(se.strategy_hot(br.draws(s, d), SIZE, 30, 6), SIZE, 6, 100)
    return scores.select("lottery", F.round(F.col("hits") / F.col("n"), 9).alias("mean"), F.round(F.sqrt(F.lit(VAR) / F.col("n")), 9).alias("se"), F.lit(MU).alias("mu"))


_add(
    "t31_bayes",
    f"WITH {DRAWS}{CELLS}, s AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS score FROM cells), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lottery, ord ORDER BY score DESC, num) <= 6), "
    f"g AS (SELECT lottery, round(sum(hit) / count(DISTINCT ord), 9) AS mean, round(sqrt({VAR!r} / count(DISTINCT ord)), 9) AS se, {MU!r}::DOUBLE AS mu FROM r WHERE ord > 100 GROUP BY 1), b AS (SELECT *, mean - mu AS d, se * se AS s2, mu * 0.01 * (mu * 0.01) AS t2 FROM g), l AS (SELECT *, -0.5 * ln((s2 + t2) / s2) - 0.5 * d * d / (s2 + t2) + 0.5 * d * d / s2 AS lg FROM b) SELECT lottery, mean, se, mu, round(lg, 5) AS log_bf, round(exp(lg) * 0.25 / (exp(lg) * 0.25 + 0.75), 6) AS p_edge, round((d / s2) / (1 / s2 + 1 / t2) / sqrt(1 / (1 / s2 + 1 / t2)), 6) AS z_edge FROM l",
    lambda s, d: sg.bayes_edge(_edges(s, d)).drop("p_positive"),
)
_add("t32_win_rate", SETTLED + f"SELECT strategy, count(*) AS n, count(grade) AS won, round(count(grade) / count(*), 6) AS rate, round(count(*) * {ANY!r}, 4) AS expected, round((count(grade) - count(*) * {ANY!r}) / sqrt(count(*) * {ANY * (1 - ANY)!r}), 5) AS z FROM ev GROUP BY 1", lambda s, d: sg.win_rate_check(settle(br.tickets(s, d), br.draws(s, d)), ANY).drop("p", "label"))
PICKS = "pa AS (SELECT lottery, ord, sum(hit) AS x FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lottery, ord ORDER BY hot DESC, num) <= 6) GROUP BY 1, 2), pb AS (SELECT lottery, ord, sum(hit) AS y FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lottery, ord ORDER BY late DESC, num) <= 6) GROUP BY 1, 2)"
NEED = special._NORMAL.inv_cdf(0.975) + special._NORMAL.inv_cdf(0.8)
_add(
    "b15_paired",
    f"WITH {DRAWS}{CELLS}, s AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS hot, ord - coalesce(max(CASE WHEN hit = 1 THEN ord END) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM cells), {PICKS}, "
    f"g AS (SELECT lottery, count(*) AS n, avg(x - y) AS d, stddev(x - y) AS s, corr(x, y) AS r FROM pa JOIN pb USING (lottery, ord) GROUP BY 1) SELECT lottery, true AS comparable, n, round(d, 6) AS difference, round(s, 6) AS deviation, round(d / (s / sqrt(n)), 5) AS z, round(d - 1.959963984540054 * s / sqrt(n), 6) AS lo, round(d + 1.959963984540054 * s / sqrt(n), 6) AS hi, round(r, 6) AS rho, ceil(round({NEED * NEED!r} * s * s / (d * d), 6))::BIGINT AS needed FROM g",
    lambda s, d: sg.paired_compare(se.strategy_hot(br.draws(s, d), SIZE, 30, 6), se.strategy_overdue(br.draws(s, d), SIZE, 6), "hits").drop("p"),
)
