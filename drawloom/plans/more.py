"""Queries on completeness, series, strategies and feedback with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import completeness as cp
from ..operators import draw_stats as st
from ..operators import feedback as fb
from ..operators import merge as mg
from ..operators import series as se
from ..operators.settle import settle
from . import bridge as br
from .bridge import DRAWS, SOURCES, TICKETS
from .sql_parts import CELLS, FREQ, NUM, ORD, SETTLED, SIZE

QUERIES, ORACLES = {}, {}
#: First issues of the artificial rule versions.
VERSIONS = [(1993, 1), (1995, 100), (1997, 50)]


def _add(name, sql, make):
    QUERIES[name] = make
    ORACLES[name] = sql


def _settled(s, d):
    return settle(br.tickets(s, d), br.draws(s, d))


def _numbers(s, d):
    return st.draw_numbers(br.draws(s, d))


def _remote(draws):
    """The draws with some missing and some with other numbers."""
    other = F.when(F.expr("k % 29 = 0"), F.array(*(F.lit(i).cast("bigint") for i in range(1, 7)))).otherwise(F.col("front"))
    return draws.where("k % 23 <> 0").withColumn("front", other)


REMOTE = "remote AS (SELECT * REPLACE (CASE WHEN k % 29 = 0 THEN [1, 2, 3, 4, 5, 6]::BIGINT[] ELSE front END AS front) FROM draws WHERE k % 23 <> 0)"
KEYS = "lottery, issue_year, issue_seq"

# completeness
_add(
    "m5_backfill",
    f"WITH {SOURCES}, {REMOTE}, j AS (SELECT l.lottery, l.issue_year, l.issue_seq, l.sales AS s, r.sales AS w, CASE WHEN coalesce(l.sales, 0) <> 0 THEN 'kept' WHEN r.front IS NULL THEN 'not_found' WHEN l.front <> r.front THEN 'mismatched' WHEN r.sales > 0 THEN 'filled' ELSE 'empty' END AS state "
    f"FROM sources l LEFT JOIN remote r USING ({KEYS}) WHERE l.source = 'csv') SELECT {KEYS}, CASE WHEN state = 'filled' THEN w ELSE s END AS sales, state FROM j",
    lambda s, d: cp.backfill_sales(br.sources(s, d).where("source = 'csv'"), _remote(br.draws(s, d))),
)
_add("m11_calendar", f"WITH {DRAWS}, e AS (SELECT lottery, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM draws GROUP BY lottery) SELECT * FROM e WHERE isodow(day) IN (2, 4, 7) AND NOT EXISTS (SELECT 1 FROM draws WHERE draws.lottery = e.lottery AND draw_date = day)", lambda s, d: cp.calendar_missing(br.draws(s, d), [1, 3, 6]))
CLOSED = [("1996-02-10", "1996-02-25"), ("1997-10-01", "1997-10-07")]
_add("m11_open", f"WITH {DRAWS}, e AS (SELECT lottery, CAST(unnest(generate_series(min(draw_date), max(draw_date), INTERVAL 1 DAY)) AS DATE) AS day FROM draws GROUP BY lottery) SELECT * FROM e WHERE isodow(day) IN (2, 4, 7) AND NOT EXISTS (SELECT 1 FROM draws WHERE draws.lottery = e.lottery AND draw_date = day) AND NOT (" + " OR ".join(f"day BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in CLOSED) + ")", lambda s, d: cp.calendar_open(br.draws(s, d), [1, 3, 6], s.createDataFrame(CLOSED, "a string, b string").select(F.to_date("a").alias("first"), F.to_date("b").alias("last"))))
_add("m11_lag", f"WITH {DRAWS}, l AS (SELECT lottery, max(draw_date) AS latest FROM draws WHERE lottery <> 'g2' OR issue_year < 2000 GROUP BY 1), x AS (SELECT max(day) AS expected FROM (SELECT CAST(unnest(generate_series((SELECT max(latest) FROM l) - INTERVAL 6 DAY, (SELECT max(latest) FROM l), INTERVAL 1 DAY)) AS DATE) AS day) WHERE isodow(day) IN (2, 4, 7)) SELECT lottery, latest, expected, greatest(0, date_diff('day', latest, expected)) AS lag FROM l, x", lambda s, d: cp.calendar_lag(br.draws(s, d).where("lottery <> 'g2' or issue_year < 2000"), [1, 3, 6]))
_add("m12_one_sided", f"WITH {DRAWS}, a AS (SELECT {KEYS} FROM draws WHERE k % 17 <> 0), b AS (SELECT {KEYS} FROM draws WHERE k % 19 <> 0) SELECT *, 'history' AS only_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'sales' FROM (FROM b EXCEPT FROM a)", lambda s, d: cp.one_sided_issues(br.draws(s, d).where("k % 17 <> 0"), br.draws(s, d).where("k % 19 <> 0")))
_add(
    "m13_verify",
    f"WITH {DRAWS}, {REMOTE}, l AS (SELECT * FROM draws QUALIFY row_number() OVER (PARTITION BY lottery ORDER BY issue_year DESC, issue_seq DESC) <= 50) SELECT l.lottery, count(*) FILTER (l.front = r.front) AS equal, count(*) FILTER (l.front <> r.front) AS different, count(*) FILTER (r.front IS NULL) AS missing FROM l LEFT JOIN remote r USING ({KEYS}) GROUP BY 1",
    lambda s, d: cp.verify_latest(br.draws(s, d), _remote(br.draws(s, d)), 50),
)
_add(
    "v1_validate",
    "WITH x AS (SELECT o_orderkey AS k, [1 + (o_orderkey * i) % 35 for i in range(1, CASE WHEN o_orderkey % 10 = 0 THEN 6 ELSE 7 END)] AS n FROM orders) SELECT k, concat_ws(',', CASE WHEN len(n) <> 6 THEN 'count' END, CASE WHEN list_max(n) > 33 OR list_min(n) < 1 THEN 'range' END, CASE WHEN len(list_distinct(n)) < len(n) THEN 'repeat' END) AS errors FROM x",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr("transform(sequence(1, if(o_orderkey % 10 = 0, 5, 6)), i -> 1 + (o_orderkey * i) % 35)").alias("n")).select("k", F.array_join(cp.number_errors(F.col("n"), 6, 1, 33), ",").alias("errors")),
)
_add(
    "v4_ticket_bets",
    "WITH x AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(6 + l_partkey % 10 AS INTEGER) AS pool, CAST(l_suppkey % 7 AS INTEGER) AS b, l_linenumber AS bonus FROM lineitem), y AS (SELECT *, pool - b AS n, 6 - b AS c FROM x) SELECT k, line, CASE WHEN c > 0 THEN CAST(factorial(n) // (factorial(c) * factorial(n - c)) AS BIGINT) * bonus ELSE 0 END AS bets FROM y",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), cp.ticket_bets(F.expr("6 + l_partkey % 10").cast("int"), F.expr("l_suppkey % 7").cast("int"), 6, F.col("l_linenumber")).alias("bets")),
)
_add("b9_unique", f"WITH {TICKETS} SELECT ticket_id, batch, strategy FROM tickets QUALIFY row_number() OVER (PARTITION BY strategy, tier, main, bonus ORDER BY ticket_id) = 1", lambda s, d: cp.unique_feedback(br.tickets(s, d), ["strategy", "tier", "main", "bonus"], "ticket_id").select("ticket_id", "batch", "strategy"))
_add(
    "w7_rule_version",
    f"WITH {DRAWS}, v AS (SELECT k, issue_year * 100000 + issue_seq AS key FROM draws) SELECT k, CASE WHEN key >= 199700050 THEN 3 WHEN key >= 199500100 THEN 2 WHEN key >= 199300001 THEN 1 END AS version FROM v",
    lambda s, d: br.draws(s, d).select("k", cp.rule_version(F.expr("issue_year * 100000 + issue_seq"), VERSIONS).alias("version")),
)

# series
OMIT = "om AS (SELECT dom.lottery, dom.num, (SELECT max(ord) FROM n WHERE n.lottery = dom.lottery) - coalesce(max(num.ord), 0) AS omitted FROM dom LEFT JOIN num ON num.lottery = dom.lottery AND num.num = dom.num GROUP BY 1, 2)"
_add("a4_summary", f"WITH {DRAWS}{FREQ}, {OMIT} SELECT f.lottery, count(*) AS size, round(6 / count(*), 6) AS rate, round(avg(times), 6) AS mean, round(stddev_pop(times), 6) AS deviation, array_to_string(list_slice(list(num ORDER BY times DESC, num), 1, 5), '-') AS hot, array_to_string(list_slice(list(num ORDER BY times, num), 1, 5), '-') AS cold, max(omitted) AS max_omission FROM f JOIN om USING (lottery, num) GROUP BY f.lottery", lambda s, d: se.summary_stats(st.frequency(_numbers(s, d), SIZE), st.omission(st.numbered(br.draws(s, d)), SIZE), 6))
_add("a5_volatility", f"WITH {DRAWS}{FREQ}, g AS (SELECT lottery, stddev_pop(times) AS seen, sqrt(sum(times) / 6 * (6.0 / count(*)) * (1 - 6.0 / count(*))) AS expected FROM f GROUP BY lottery) SELECT lottery, round(seen, 6) AS seen, round(expected, 6) AS expected, round((seen / expected - 1) * 100, 4) AS excess FROM g", lambda s, d: se.volatility(st.frequency(_numbers(s, d), SIZE), 6))
_add("w8_dry_runs", f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord - row_number() OVER (PARTITION BY lottery ORDER BY ord) AS spell FROM n WHERE first_winners = 0), y AS (SELECT lottery, spell, count(*) AS c FROM x GROUP BY 1, 2) SELECT lottery, count(*) AS spells, max(c) AS longest FROM y GROUP BY 1", lambda s, d: se.dry_runs(br.draws(s, d)))
_add("w8_same_value", f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord, back[1] AS v, ord - row_number() OVER (PARTITION BY lottery, back[1] ORDER BY ord) AS spell FROM n), y AS (SELECT lottery, v, spell, count(*) AS c, min(ord) AS first FROM x GROUP BY 1, 2, 3) SELECT lottery, c AS longest, first, v AS number FROM y QUALIFY row_number() OVER (PARTITION BY lottery ORDER BY c DESC, first) = 1", lambda s, d: se.same_value_runs(br.draws(s, d)))
_add("w11_segments", f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, sales, (ord - 1) * 4 // count(*) OVER (PARTITION BY lottery) AS segment FROM n), g AS (SELECT lottery, segment, count(*) AS draws, median(sales) AS m FROM x GROUP BY 1, 2) SELECT lottery, segment, draws, round(m, 4) AS middle, abs(last_value(m) OVER w / first_value(m) OVER w - 1) > 0.2 AS shifted FROM g WINDOW w AS (PARTITION BY lottery ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", lambda s, d: se.segments(br.draws(s, d), 4))
_add("w12_folds", f"WITH {DRAWS}{ORD}, x AS (SELECT lottery, ord, count(*) OVER (PARTITION BY lottery) AS c FROM n), y AS (SELECT lottery, ord, (ord - 101) * 5 // (c - 100) AS fold FROM x WHERE ord > 100) SELECT lottery, fold, count(*) AS validate, min(ord) - 1 AS train FROM y GROUP BY 1, 2", lambda s, d: se.walk_forward_folds(br.draws(s, d), 5, 100))
_add("t4_serial_pairs", f"WITH {DRAWS}{ORD}, p AS (SELECT lottery, back[1] AS x, lag(back[1]) OVER (PARTITION BY lottery ORDER BY ord) AS y FROM n), c AS (SELECT lottery, x, y, count(*) AS c FROM p WHERE y IS NOT NULL GROUP BY ALL) SELECT lottery, CAST(sum(c) AS BIGINT) AS n, round(sum(c * c) * 256 / sum(c) - sum(c), 6) AS chi2, CAST(255 AS BIGINT) AS df FROM c GROUP BY lottery", lambda s, d: se.serial_pairs(br.draws(s, d), 16))
_add("t6_blocks", f"WITH {DRAWS}{ORD}, c AS (SELECT lottery, (ord - 1) // 100 AS block, back[1] AS x, count(*) AS c FROM n GROUP BY ALL), b AS (SELECT lottery, block, sum(c) AS m, sum(c * c) AS sq FROM c GROUP BY ALL HAVING sum(c) = 100) SELECT lottery, count(*) AS blocks, round(sum(sq) * 16 / 100 - count(*) * 100, 6) AS chi2, count(*) * 15 AS df, (sum(sq) * 16 / 100 - count(*) * 100) / (count(*) * 15) > 1.5 AS excess FROM b GROUP BY lottery", lambda s, d: se.block_frequency(br.draws(s, d), 16, 100))
_add("t13_benford", f"WITH {DRAWS}, g AS (SELECT lottery, CAST(left(CAST(sales AS VARCHAR), 1) AS INTEGER) AS d, count(*) AS c FROM draws WHERE sales > 0 GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY lottery) AS m FROM g) SELECT lottery, CAST(max(m) AS BIGINT) AS n, round(sum(c * c / (m * log10(1 + 1 / d))) - max(m), 6) AS chi2 FROM t GROUP BY lottery", lambda s, d: se.benford(br.draws(s, d), "sales"))
_add("t15_recent", f"WITH {DRAWS}{NUM}, t AS (SELECT lottery, max(ord) AS c FROM num GROUP BY 1), g AS (SELECT num.lottery, num, max(c) AS c, count(*) AS times, count(*) FILTER (ord > c - 30) AS lately FROM num JOIN t ON t.lottery = num.lottery GROUP BY 1, 2) SELECT lottery, num, times, lately, round((lately / 30 - times / c) / sqrt(times / c * (1 - times / c) / 30), 6) AS z FROM g WHERE times < c", lambda s, d: se.recent_shift(st.numbered(br.draws(s, d)), 30))
_add("e2_overlap", f"WITH {DRAWS} SELECT k, CASE WHEN prev IS NOT NULL THEN len(list_intersect(front, prev)) END AS shared FROM (SELECT k, front, lag(front) OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS prev FROM draws)", lambda s, d: se.previous_overlap(br.draws(s, d)))
PICK = ", r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lottery, ord ORDER BY score DESC, num) <= 6), picks AS (SELECT lottery, ord, string_agg(num, '-' ORDER BY num) AS numbers, CAST(sum(hit) AS BIGINT) AS hits FROM r GROUP BY 1, 2) "
HOT = f"WITH {DRAWS}{CELLS}, s AS (SELECT *, coalesce(sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0) AS score FROM cells)" + PICK
OVERDUE = f"WITH {DRAWS}{CELLS}, s AS (SELECT *, ord - coalesce(max(CASE WHEN hit = 1 THEN ord END) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS score FROM cells)" + PICK
SCORE = "SELECT lottery, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, round((sum(hits) / count(*) - 36 / 33) / sqrt(36 / 33 * 27 / 33 * 27 / 32 / count(*)), 6) AS z FROM picks WHERE ord > 100 GROUP BY lottery"
_add("b1_hot", HOT + "SELECT * FROM picks", lambda s, d: se.strategy_hot(br.draws(s, d), SIZE, 30, 6))
_add("b2_overdue", OVERDUE + "SELECT * FROM picks", lambda s, d: se.strategy_overdue(br.draws(s, d), SIZE, 6))
_add("b17_backtest", OVERDUE + SCORE, lambda s, d: se.strategy_score(se.strategy_overdue(br.draws(s, d), SIZE, 6), SIZE, 6, 100))

# feedback
_add("l4_tiers", SETTLED + "SELECT tier, count(*) AS tickets, count(DISTINCT draw_k) AS draws, count(grade) AS wins, round(avg(h * CAST(0.6 AS DOUBLE) + j * CAST(0.4 AS DOUBLE)), 6) AS score, round(count(grade) / count(*), 6) AS rate FROM ev GROUP BY tier", lambda s, d: fb.tier_comparison(_settled(s, d)))
WEIGHED = ", g AS (SELECT strategy, count(*) AS tickets, avg(h * CAST(0.6 AS DOUBLE) + j * CAST(0.4 AS DOUBLE)) AS score FROM ev GROUP BY 1), w AS (SELECT *, count(*) OVER () AS n, CASE WHEN tickets < 10 THEN 1 / count(*) OVER () ELSE greatest(CASE WHEN score < 0 THEN score * 0.5 ELSE score END, 1e-6) END AS raw FROM g)"
_add("l5_weights", SETTLED + WEIGHED + " SELECT strategy, tickets, round(0.05 + (1 - n * 0.05) * raw / (sum(raw) OVER () + 1e-8), 6) AS weight FROM w", lambda s, d: fb.strategy_weights(_settled(s, d)))
_add("l5_gated", SETTLED + WEIGHED + ", x AS (SELECT strategy, tickets, n, CASE WHEN strategy = 'A' THEN 0.5::DOUBLE ELSE 0.5::DOUBLE / (n - 1) END AS raw FROM w) SELECT strategy, tickets, round(0.05 + (1 - n * 0.05) * raw / (sum(raw) OVER () + 1e-8), 6) AS weight FROM x", lambda s, d: fb.strategy_weights(_settled(s, d), gate=["A"]))
_add("w9_trend", SETTLED + ", r AS (SELECT *, h + j AS t, row_number() OVER (PARTITION BY strategy ORDER BY draw_date DESC, ticket_id DESC, h + j DESC) AS place FROM ev), g AS (SELECT strategy, count(*) AS c, round(avg(t) FILTER (place <= 10) - avg(t) FILTER (place > 10), 6) AS change FROM r WHERE place <= 20 GROUP BY 1) SELECT strategy, CASE WHEN c < 10 OR change IS NULL THEN 'none' WHEN change > 0.15 THEN 'up' WHEN change < -0.15 THEN 'down' ELSE 'flat' END AS trend, change FROM g", lambda s, d: fb.hit_trend(_settled(s, d)))
LEDGER = ", led AS (SELECT draw_k AS k, count(*) AS tickets, CAST(sum(amount) AS BIGINT) AS gross, count(grade) AS wins, count(*) FILTER (amount >= 10) AS ten_or_more, count(*) * 2 AS cost FROM ev GROUP BY 1) "
FILLED = ", fil AS (SELECT d.lottery, d.k, led.k IS NOT NULL AS took_part, coalesce(tickets, 0) AS tickets, coalesce(gross, 0) AS gross, coalesce(wins, 0) AS wins, coalesce(ten_or_more, 0) AS ten_or_more, coalesce(cost, 0) AS cost FROM draws d LEFT JOIN led ON led.k = d.k) "
_add("l7_ledger", SETTLED + LEDGER + "SELECT * FROM led", lambda s, d: fb.batch_ledger(_settled(s, d)))
_add("l8_filled", SETTLED + LEDGER + FILLED + "SELECT * FROM fil", lambda s, d: fb.filled_ledger(fb.batch_ledger(_settled(s, d)), br.draws(s, d)))
_add("l10_summary", SETTLED + LEDGER + FILLED + ", g AS (SELECT lottery, count(*) AS draws, count(*) FILTER (took_part) AS taken, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(gross) AS BIGINT) AS gross, round(sum(CASE WHEN gross > 10000 THEN gross * CAST(0.2 AS DOUBLE) ELSE 0.0 END), 4) AS tax, count(*) FILTER (wins > 0) AS won FROM fil GROUP BY 1) SELECT *, round(gross - tax - cost, 4) AS net, round(won / nullif(taken, 0), 6) AS hit_share FROM g", lambda s, d: fb.ledger_summary(fb.filled_ledger(fb.batch_ledger(_settled(s, d)), br.draws(s, d))))
_add("l11_lift", SETTLED + ", r AS (SELECT score, count(*) AS t, count(grade) AS w FROM ev GROUP BY 1), b AS (SELECT *, ntile(5) OVER (ORDER BY score) AS bin FROM r), g AS (SELECT bin, CAST(sum(t) AS BIGINT) AS tickets, CAST(sum(w) AS BIGINT) AS wins FROM b GROUP BY 1) SELECT bin, tickets, wins, round(wins / tickets, 6) AS rate, round(wins / tickets / (sum(wins) OVER () / sum(tickets) OVER ()), 6) AS lift, round(sqrt(wins / tickets * (1 - wins / tickets) / tickets), 6) AS se, coalesce((SELECT bool_and(up) FROM (SELECT wins / tickets >= lag(wins / tickets) OVER (ORDER BY bin) AS up FROM g)), true) AS rising FROM g", lambda s, d: fb.lift(_settled(s, d)))
_add("l12_budget", SETTLED + "SELECT CAST(date_trunc('month', draw_date) AS DATE) AS month, lottery, count(*) * 2 AS spent, count(DISTINCT batch) AS batches FROM ev GROUP BY GROUPING SETS ((1), (2), (1, 2))", lambda s, d: fb.budget_groups(_settled(s, d)))
_add(
    "b16_arm_overlap",
    f"WITH {TICKETS}, c AS (SELECT main, max(CAST(strategy = 'A' AS INTEGER)) AS a, max(CAST(strategy = 'N' AS INTEGER)) AS b FROM tickets WHERE strategy IN ('A', 'N') GROUP BY 1), g AS (SELECT CAST(sum(a) AS BIGINT) AS in_a, CAST(sum(b) AS BIGINT) AS in_b, CAST(sum(a * b) AS BIGINT) AS \"both\" FROM c) "
    "SELECT in_a, in_b, \"both\", round(in_a * in_b / 1107568, 6) AS expected, round((\"both\" - in_a * in_b / 1107568) / sqrt(in_a * in_b / 1107568 * (1 - in_a / 1107568) * (1107568 - in_b) / 1107567), 6) AS z FROM g",
    lambda s, d: fb.arm_overlap(br.tickets(s, d), "A", "N", 1_107_568),
)


def _by_issue(s, d):
    """Region rows by issue text: most under the full text, of some draws under another one too."""
    rows = br.stored_regions(s, d).select("k", "lottery").join(br.draws(s, d).select("k", "issue_year", "issue_seq"), "k")
    full = F.concat(F.col("issue_year").cast("string"), br.five("issue_seq"))
    return rows.select("lottery", F.when(F.col("k") % 9 == 0, F.concat(F.lit("P"), F.col("issue_seq").cast("string"))).otherwise(full).alias("issue"))


_BEST = "CASE source WHEN 'official' THEN 1 WHEN 'agg' THEN 2 ELSE 3 END"
_add(
    "m2_full",
    f"""WITH {br.STORED}{br.FULL[len(br.DRAWS):]},
by_issue AS (SELECT lottery, CASE WHEN k % 9 = 0 THEN 'P' || issue_seq ELSE CAST(issue_year AS VARCHAR) || {br.FIVE} END AS issue FROM stored JOIN (SELECT k, issue_year, issue_seq FROM draws) USING (k)),
n AS (SELECT lottery, issue, count(*) AS region_n FROM by_issue GROUP BY ALL),
w AS (SELECT * FROM full_sources QUALIFY row_number() OVER (PARTITION BY lottery, issue_year, issue_seq ORDER BY {_BEST}, length(issue) DESC, issue DESC) = 1),
a AS (SELECT lottery, issue_year, issue_seq, max(nullif(seq, '')) AS seq, max(sales) AS sales, max(pool) AS pool, max(first_winners) AS fw, max(nullif(region_text, '')) AS region_text, count(*) AS n_src, string_agg(source, ',' ORDER BY source) AS srcs FROM full_sources GROUP BY ALL)
SELECT w.lottery, w.issue_year, w.issue_seq, w.issue, w.draw_date, w.front, w.back, w.source, coalesce(nullif(w.seq, ''), a.seq) AS seq, coalesce(w.sales, a.sales) AS sales, coalesce(w.pool, a.pool) AS pool, coalesce(w.first_winners, a.fw) AS first_winners, a.region_text, a.n_src, a.srcs, coalesce(region_n, 0) AS region_n
FROM w JOIN a USING (lottery, issue_year, issue_seq) LEFT JOIN n ON n.lottery = w.lottery AND n.issue = w.issue""",
    lambda s, d: mg.merge_full(br.full_sources(s, d), _by_issue(s, d)),
)
