"""Queries over the driver's tables and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import draw_stats as st
from ..operators import merge as mg
from ..operators import regions as rg
from ..operators import settle as se
from ..operators import standings as sd
from ..streaming import jobs
from . import bridge as br
from . import more
from .bridge import DRAWS, SOURCES, TICKETS, WINNERS
from .sql_parts import CELLS, CHI, FREQ, NUM, ORD, PRI, RULES, SETTLED, SIZE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = make
    if sql:
        ORACLES[name] = sql


def _gappy(d: DataFrame) -> DataFrame:
    return d.where("k % 17 <> 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge the sources, then the ten hottest numbers of every game with their omissions and the game's chi-square."""
    merged = mg.merge_sources(br.sources(spark, sf_dir))
    freq = st.frequency(st.draw_numbers(merged), SIZE)
    hot = st.hot_cold(freq, 10).where("kind = 'hot'").drop("kind")
    return hot.join(st.omission(st.numbered(merged), SIZE), ["lottery", "num"]).join(st.uniformity(freq, 6).select("lottery", "chi2"), "lottery")


def _settled(s, d):
    return se.settle(br.tickets(s, d), br.draws(s, d))


# scalar functions
_add(
    "f1_issue_key",
    f"WITH {SOURCES} SELECT source, k, CAST(issue_year AS INTEGER) AS year, CAST(issue_seq AS INTEGER) AS seq FROM sources",
    lambda s, d: br.sources(s, d).withColumn("key", scalar.issue_key(F.col("issue"))).select("source", "k", "key.year", "key.seq"),
)
_add(
    "f3_money",
    "SELECT o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS money FROM orders",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), scalar.to_int_money(F.concat(F.lit(" "), F.format_number("o_totalprice", 2))).alias("money")),
)
_add(
    "f10_shapes",
    f"WITH {DRAWS} SELECT k, CAST(list_sum(front) AS BIGINT) AS total, front[6] - front[1] AS span, len(list_filter(front, lambda x: x % 2 = 1)) AS odd, len([1 for i in [1, 2, 3, 4, 5] if front[i + 1] - front[i] = 1]) AS pairs, "
    "list_min([front[i + 1] - front[i] for i in [1, 2, 3, 4, 5]]) AS min_gap, list_max([front[i + 1] - front[i] for i in [1, 2, 3, 4, 5]]) AS max_gap, "
    "len(list_distinct(flatten([[front[j] - front[i] for j in [1, 2, 3, 4, 5, 6] if j > i] for i in [1, 2, 3, 4, 5, 6]]))) - 5 AS complexity FROM draws",
    lambda s, d: br.draws(s, d).select("k", *(c.alias(n) for n, c in scalar.shape_features(F.col("front")).items() if n in ("total", "span", "odd", "pairs", "min_gap", "max_gap", "complexity"))),
)
_add("f16_tax", "SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_extendedprice > 10000 THEN l_extendedprice * 0.2 ELSE 0.0 END AS tax FROM lineitem", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), scalar.tax(F.col("l_extendedprice")).alias("tax")))

# merging
_add("m1_best_source", f"WITH {SOURCES} SELECT lottery, issue_year, issue_seq, source, sales FROM sources QUALIFY row_number() OVER (PARTITION BY lottery, issue_year, issue_seq ORDER BY {PRI}, issue) = 1", lambda s, d: mg.best_source(br.sources(s, d).where("k % 4 <> 1 or source <> 'official'")).select(*mg.KEY, "source", "sales"))
ORACLES["m1_best_source"] = ORACLES["m1_best_source"].replace("FROM sources QUALIFY", "FROM sources WHERE k % 4 <> 1 OR source <> 'official' QUALIFY")
_add(
    "m2_merge",
    f"WITH {SOURCES} SELECT lottery, issue_year, issue_seq, arg_min(front, {PRI}) AS front, arg_min(sales, {PRI}) FILTER (sales IS NOT NULL) AS sales, arg_min(source, {PRI}) AS source, count(DISTINCT source) AS n_src, string_agg(source, ',' ORDER BY source) AS srcs, arg_min(back, {PRI}) AS back, min(draw_date) AS draw_date, arg_min(first_winners, {PRI}) AS first_winners FROM sources GROUP BY ALL",
    lambda s, d: mg.merge_sources(br.sources(s, d)),
)
_add("m3_upsert", f"WITH {SOURCES} SELECT k, sales FROM (SELECT k, sales, 1 AS pr, draw_date FROM sources WHERE source = 'csv' UNION ALL SELECT k, sales, 0, draw_date FROM sources WHERE source = 'agg') QUALIFY row_number() OVER (PARTITION BY k ORDER BY draw_date DESC, pr DESC) = 1", lambda s, d: mg.latest_upsert(br.sources(s, d).where("source = 'agg'").select("k", "sales", "draw_date"), br.sources(s, d).where("source = 'csv'").select("k", "sales", "draw_date"), ["k"], "draw_date").select("k", "sales"))
_add(
    "m4_append",
    f"WITH {DRAWS}, loc AS (SELECT * FROM draws WHERE issue_year < 1997), last AS (SELECT lottery, max((issue_year, issue_seq)) AS m FROM loc GROUP BY 1) SELECT d.lottery, d.issue_year, d.issue_seq FROM draws d LEFT JOIN last USING (lottery) WHERE m IS NULL OR (d.issue_year, d.issue_seq) > m",
    lambda s, d: mg.append_new(br.draws(s, d).where("issue_year < 1997").select(*mg.KEY), br.draws(s, d).select(*mg.KEY)).select(*mg.KEY),
)
_add(
    "m6_reconcile",
    f"WITH {SOURCES}, a AS (SELECT * FROM sources WHERE source = 'official' AND k % 19 <> 0), b AS (SELECT * FROM sources WHERE source = 'csv'), j AS (SELECT coalesce(a.lottery, b.lottery) AS lottery, a.front AS af, b.front AS bf, a.sales AS s, b.sales AS t FROM a FULL JOIN b ON a.lottery = b.lottery AND a.issue_year = b.issue_year AND a.issue_seq = b.issue_seq) "
    "SELECT lottery, count(*) FILTER (af IS NOT NULL AND bf IS NOT NULL) AS paired, count(*) FILTER (af = bf) AS numbers_agree, count(*) FILTER (af IS NOT NULL AND bf IS NOT NULL AND (s = 0) = (t = 0) AND abs(s - t) <= 1) AS sales_agree, count(*) FILTER (af IS NOT NULL AND bf IS NOT NULL AND (s = 0) = (t = 0) AND abs(s - t) > 1) AS sales_conflict, count(*) FILTER ((s = 0) <> (t = 0)) AS zero_side, count(*) FILTER (bf IS NULL) AS only_a, count(*) FILTER (af IS NULL) AS only_b FROM j GROUP BY lottery",
    lambda s, d: mg.reconcile(br.sources(s, d).where("source <> 'official' or k % 19 <> 0"), "official", "csv"),
)
_add("m7_gaps", f"WITH {DRAWS} SELECT lottery, issue_year, prev_seq, issue_seq, issue_seq - prev_seq - 1 AS missing FROM (SELECT *, lag(issue_seq) OVER (PARTITION BY lottery, issue_year ORDER BY issue_seq) AS prev_seq FROM draws WHERE k % 17 <> 0) WHERE issue_seq - prev_seq > 1", lambda s, d: mg.draw_gaps(_gappy(br.draws(s, d))))
_add("m8_missing", f"WITH {DRAWS}, g AS (SELECT * FROM draws WHERE k % 17 <> 0), e AS (SELECT lottery, issue_year, unnest(range(min(issue_seq), max(issue_seq) + 1)) AS issue_seq FROM g GROUP BY 1, 2) SELECT * FROM e ANTI JOIN g USING (lottery, issue_year, issue_seq)", lambda s, d: mg.missing_issues(_gappy(br.draws(s, d))))
_add("m9_duplicates", f"WITH {DRAWS} SELECT lottery, array_to_string(front, '-') AS numbers, count(*) AS times FROM draws GROUP BY 1, 2 HAVING count(*) > 1", lambda s, d: mg.duplicate_draws(br.draws(s, d)))
_add("m10_date_gaps", f"WITH {DRAWS} SELECT lottery, max(x) AS longest, count(*) FILTER (x > 7) AS over, count(*) FILTER (x = 0) AS same_day FROM (SELECT lottery, date_diff('day', lag(draw_date) OVER (PARTITION BY lottery ORDER BY draw_date, k), draw_date) AS x FROM draws) GROUP BY lottery", lambda s, d: mg.date_gaps(br.draws(s, d), 7))
_add("m14_coverage", f"WITH {SOURCES} SELECT lottery, source, count(*) AS draws, min(draw_date) AS first_date, max(draw_date) AS last_date, count(sales) AS with_sales, count(*) FILTER (front <> list_sort(front)) AS with_order FROM sources GROUP BY ALL", lambda s, d: mg.source_coverage(br.sources(s, d)))
_add("m9_excess", f"WITH {DRAWS}, c AS (SELECT lottery, front, count(*) AS c FROM draws GROUP BY 1, 2), g AS (SELECT lottery, sum(c)::BIGINT AS n, sum(c - 1)::BIGINT AS repeats FROM c GROUP BY 1) SELECT lottery, n, repeats, round(n * (n - 1) / (2.0 * 1107568), 6) AS expected, round((repeats - n * (n - 1) / (2.0 * 1107568)) / sqrt(n * (n - 1) / (2.0 * 1107568)), 6) AS z FROM g", lambda s, d: mg.duplicate_excess(br.draws(s, d), 1_107_568))
_add("m9_duplicate_issues", f"WITH {SOURCES}, two AS (SELECT lottery, source, issue FROM sources UNION ALL SELECT lottery, source, issue FROM sources WHERE k % 31 = 0) SELECT lottery, source, issue, count(*) AS times FROM two GROUP BY ALL HAVING count(*) > 1", lambda s, d: mg.duplicate_issues(br.sources(s, d).select("lottery", "source", "issue").unionByName(br.sources(s, d).where("k % 31 = 0").select("lottery", "source", "issue"))))
_add(
    "m15_search",
    f"WITH {SOURCES}, m AS (SELECT lottery, issue_year, issue_seq, arg_min(front, {PRI}) AS front, arg_min(back, {PRI}) AS back, arg_min(sales, {PRI}) FILTER (sales IS NOT NULL) AS sales, min(draw_date) AS draw_date, min(first_winners) AS first_winners, string_agg(source, ',' ORDER BY source) AS srcs FROM sources GROUP BY ALL), "
    f"f AS (SELECT * FROM m WHERE lottery IN ('g1', 'g3') AND list_has_any(string_split(srcs, ','), ['agg', 'csv']) AND draw_date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND sales BETWEEN 100 * 10000 AND 3000 * 10000 AND first_winners BETWEEN 1 AND 9 AND list_contains(front, 7) AND list_contains(back, 12) AND (issue_year || {br.FIVE} LIKE '%1%' OR CAST(draw_date AS VARCHAR) LIKE '%1%')) "
    "SELECT lottery, issue_year, issue_seq, sales, place, total FROM (SELECT *, row_number() OVER (ORDER BY sales DESC NULLS LAST, lottery, issue_year, issue_seq) AS place, count(*) OVER () AS total FROM f) WHERE place BETWEEN 3 AND 4",
    lambda s, d: mg.draw_search(mg.merge_sources(br.sources(s, d)), 2, 2, ["g1", "g3"], ["agg", "csv"], ("1993-01-01", "1997-12-31"), (100, 3000), (1, 9), [7], [12], "1"),
)

# aggregates
_add("a1_frequency", f"WITH {DRAWS}{FREQ} SELECT * FROM f", lambda s, d: st.frequency(st.draw_numbers(br.draws(s, d)), SIZE))
_add("a2_hot_cold", f"WITH {DRAWS}{FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY lottery ORDER BY times DESC, num) AS hot, row_number() OVER (PARTITION BY lottery ORDER BY times, num) AS cold FROM f) SELECT lottery, CASE WHEN hot <= 5 THEN 'hot' ELSE 'cold' END AS kind, CASE WHEN hot <= 5 THEN hot ELSE cold END AS place, num, times FROM r WHERE hot <= 5 OR cold <= 5", lambda s, d: st.hot_cold(st.frequency(st.draw_numbers(br.draws(s, d)), SIZE), 5))
_add("a3_omission", f"WITH {DRAWS}{NUM} SELECT dom.lottery, dom.num, (SELECT max(ord) FROM n WHERE n.lottery = dom.lottery) - coalesce(max(num.ord), 0) AS omitted FROM dom LEFT JOIN num ON num.lottery = dom.lottery AND num.num = dom.num GROUP BY 1, 2", lambda s, d: st.omission(st.numbered(br.draws(s, d)), SIZE))
_add("a8_region_board", f"WITH {WINNERS} SELECT lottery, region, sum(winners) AS winners, count(*) AS draws, row_number() OVER (PARTITION BY lottery ORDER BY sum(winners) DESC, region) AS place, round(sum(winners) / count(*), 6) AS per_draw FROM prize_regions GROUP BY lottery, region QUALIFY place <= 5", lambda s, d: rg.region_board(br.prize_regions(s, d), 5))
_add("a9_region_shares", f"WITH {WINNERS} SELECT region, sum(sales) AS sales, sum(winners) AS winners, round(sum(sales) / sum(sum(sales)) OVER (), 9) AS sales_share, round(sum(winners) / sum(sum(winners)) OVER (), 9) AS winner_share FROM prize_regions GROUP BY region", lambda s, d: rg.region_shares(br.prize_regions(s, d)))
_add("a10_region_trend", f"WITH {WINNERS} SELECT region, issue_year, lottery, sum(winners)::BIGINT AS winners, count(*) AS draws FROM prize_regions GROUP BY 1, 2, 3", lambda s, d: rg.region_year_trend(br.prize_regions(s, d)))
_add("a10_pivot", f"WITH {WINNERS} SELECT region, issue_year, " + ", ".join(f"coalesce(sum(winners) FILTER (lottery = 'g{i}'), 0)::BIGINT AS g{i}" for i in (1, 2, 3, 4)) + " FROM prize_regions GROUP BY 1, 2", lambda s, d: rg.pivot_games(rg.region_year_trend(br.prize_regions(s, d))))
_add("a15_pairs", f"WITH {DRAWS}{NUM} SELECT x.lottery, x.num AS a, y.num AS b, count(*) AS times FROM num x JOIN num y ON x.lottery = y.lottery AND x.ord = y.ord AND x.num < y.num GROUP BY 1, 2, 3", lambda s, d: st.co_occurrence(br.draws(s, d)))
_add("a16_rollup", f"WITH {SOURCES} SELECT lottery, issue_year, source, count(*) AS draws, sum(sales)::BIGINT AS sales FROM sources GROUP BY ROLLUP (lottery, issue_year, source)", lambda s, d: st.grouping_counts(br.sources(s, d)))

# windows
_add("w1_rolling_counts", f"WITH {DRAWS}{CELLS} SELECT lottery, ord, num, sum(hit) OVER (PARTITION BY lottery, num ORDER BY ord ROWS 29 PRECEDING) AS times FROM cells", lambda s, d: st.rolling_counts(br.draws(s, d), SIZE, 30))
_add("w2_omission_history", f"WITH {DRAWS}{CELLS} SELECT lottery, ord, num, ord - 1 - coalesce(max(CASE WHEN hit = 1 THEN ord END) OVER (PARTITION BY lottery, num ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS omitted FROM cells", lambda s, d: st.omission_history(br.draws(s, d), SIZE))
_add(
    "w5_lags",
    f"WITH {DRAWS}{ORD} SELECT lottery, ord, lag(sales, 1) OVER w AS lag1, lag(sales, 2) OVER w AS lag2, CASE WHEN count(sales) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) >= 2 THEN round(avg(sales) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) END AS ma4, CASE WHEN count(sales) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) >= 4 THEN round(avg(sales) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 4) END AS ma8, round(lag(sales, 1) OVER w / nullif(lag(sales, 2) OVER w, 0) - 1, 6) AS momentum, lag(first_winners) OVER w AS winners1, CAST(sum(CASE WHEN first_winners > 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS BIGINT) AS wins8, date_diff('day', lag(draw_date) OVER w, draw_date) AS days, CAST(dayofweek(draw_date) + 1 AS BIGINT) AS weekday, CAST(month(draw_date) AS BIGINT) AS month, round(ln(1 + sales), 6) AS log_sales, ord - 1 - coalesce(max(CASE WHEN first_winners > 0 THEN ord END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dry FROM n WINDOW w AS (PARTITION BY lottery ORDER BY ord)",
    lambda s, d: st.lag_frame(br.draws(s, d)),
)

# tests
_add("t1_uniformity", f"WITH {DRAWS}{FREQ} SELECT lottery, n, df, round(chi, 6) AS chi2, round(sqrt(chi / (n * df)), 6) AS v, round(greatest(hi - n / k, n / k - lo) / (n / k), 6) AS deviation FROM ({CHI})", lambda s, d: st.uniformity(st.frequency(st.draw_numbers(br.draws(s, d)), SIZE), 6))
_add("t2_runs", f"WITH {DRAWS}{ORD}, u AS (SELECT lottery, ord, CAST(sales > median(sales) OVER (PARTITION BY lottery) AS INTEGER) AS up FROM n), t AS (SELECT lottery, up, CASE WHEN up <> lag(up) OVER (PARTITION BY lottery ORDER BY ord) THEN 1 ELSE 0 END AS turn FROM u), g AS (SELECT lottery, sum(turn) + 1 AS runs, sum(up) AS n1, sum(1 - up) AS n2 FROM t GROUP BY lottery) SELECT lottery, runs, n1, n2, round((runs - (2.0 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))), 6) AS z FROM g", lambda s, d: st.runs_test(br.draws(s, d)))
_add("t7_adjacent", f"WITH {DRAWS}, g AS (SELECT lottery, count(*) AS n, count(*) FILTER (list_has_any(front, prev)) AS repeats FROM (SELECT lottery, front, lag(front) OVER (PARTITION BY lottery ORDER BY issue_year, issue_seq) AS prev FROM draws) WHERE prev IS NOT NULL GROUP BY lottery), p AS (SELECT *, 1 - 296010.0 / 1107568 AS p FROM g) SELECT lottery, n, repeats, round((repeats / n - p) / sqrt(p * (1 - p) / n), 6) AS z, round((repeats / n - p) / p, 6) AS effect FROM p", lambda s, d: st.adjacent_repeat(br.draws(s, d), SIZE, 6))
_add("t11_serial", f"WITH {DRAWS}{ORD}, p AS (SELECT lottery, ord, i AS pos, front[i + 1] AS x FROM n, (SELECT unnest(range(0, 6)) AS i)), q AS (SELECT *, lag(x) OVER (PARTITION BY lottery, pos ORDER BY ord) AS y FROM p), c AS (SELECT lottery, pos, count(*) AS n, corr(x, y) AS r FROM q WHERE y IS NOT NULL GROUP BY 1, 2) SELECT lottery, pos, n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t, abs(r) > 0.10 AS practical FROM c", lambda s, d: st.serial_correlation(br.draws(s, d)))
_add(
    "t30_bh",
    f"WITH {DRAWS}, p AS (SELECT lottery, issue_year, issue_seq, 0.05 * ((k * 7919) % 1000 + 1) / 1000 AS p FROM draws), r AS (SELECT *, p * count(*) OVER (PARTITION BY lottery, issue_year) / row_number() OVER (PARTITION BY lottery, issue_year ORDER BY p, issue_seq) AS raw FROM p) SELECT lottery, issue_year, issue_seq, p, round(least(1.0, min(raw) OVER (PARTITION BY lottery, issue_year ORDER BY p DESC, issue_seq DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM r",
    lambda s, d: st.bh_adjust(br.draws(s, d).select(*mg.KEY, (F.lit(0.05) * ((F.col("k") * 7919) % 1000 + 1) / 1000).alias("p")), "p", ["lottery", "issue_year"], ["issue_seq"]),
)

# settlement
_add("b8_settle", SETTLED + "SELECT * FROM settled", _settled)
_add(
    "b10_replay",
    f"WITH {DRAWS}, {TICKETS}, {RULES}, tm AS (SELECT DISTINCT main FROM tickets), tc AS (SELECT main, bonus[1] AS b, count(*) AS c FROM tickets GROUP BY 1, 2), fr AS (SELECT DISTINCT front FROM draws), hh AS (SELECT front, main, len(list_intersect(main, front)) AS h FROM fr, tm), hc AS (SELECT front, h, b, sum(c) AS c FROM hh JOIN tc USING (main) GROUP BY 1, 2, 3), "
    "k AS (SELECT DISTINCT front, back FROM draws), p AS (SELECT k.front, k.back, hc.h, CASE WHEN hc.b = k.back[1] THEN 1 ELSE 0 END AS j, hc.c FROM k JOIN hc USING (front)), "
    "g AS (SELECT front, back, max(p.h) AS best, coalesce(sum(c) FILTER (grade IS NOT NULL), 0)::BIGINT AS winners, coalesce(sum(c * amount), 0)::BIGINT AS money, coalesce(min(grade), 99) <= 4 AS reached FROM p LEFT JOIN rules r ON r.h = p.h AND r.j = p.j GROUP BY 1, 2) SELECT lottery, issue_year, issue_seq, best, winners, money, reached FROM draws JOIN g USING (front, back)",
    lambda s, d: se.replay(br.tickets(s, d), br.draws(s, d), 4),
)
_add(
    "b11_ledger",
    SETTLED + ", day AS (SELECT lottery, draw_date, draw_k, count(*) AS tickets, CAST(sum(amount) AS DOUBLE) AS gross, count(grade) AS wins, CAST(count(*) * 2 AS DOUBLE) AS cost FROM ev GROUP BY 1, 2, 3), x AS (SELECT *, CASE WHEN gross > 10000 THEN gross * 0.2 ELSE 0.0 END AS tax, row_number() OVER (PARTITION BY lottery ORDER BY draw_date, draw_k) AS ord FROM day), y AS (SELECT *, gross - tax - cost AS net FROM x), z AS (SELECT *, round(sum(net) OVER w, 4) AS running FROM y WINDOW w AS (PARTITION BY lottery ORDER BY ord ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(0.0, max(running) OVER (PARTITION BY lottery ORDER BY ord ROWS UNBOUNDED PRECEDING)) AS peak FROM z), q AS (SELECT *, round(peak - running, 4) AS drawdown FROM p), "
    "u AS (SELECT *, max(drawdown) OVER w AS worst, ord - coalesce(max(CASE WHEN drawdown = 0 THEN ord END) OVER w, 0) AS under FROM q WINDOW w AS (PARTITION BY lottery ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT * EXCLUDE (ord), max(under) OVER (PARTITION BY lottery ORDER BY ord ROWS UNBOUNDED PRECEDING) AS longest_under FROM u",
    lambda s, d: se.ledger(_settled(s, d)),
)
_add("l2_attribution", SETTLED + "SELECT strategy, tier, count(*) AS tickets, count(grade) AS wins, sum(amount) AS prizes, count(*) FILTER (grade <= 5) AS ten_or_more FROM ev GROUP BY CUBE (strategy, tier)", lambda s, d: se.attribution(_settled(s, d)))
_add("l3_leaderboard", SETTLED + "SELECT strategy, count(*) AS tickets, round(avg(h), 6) AS mean_main, round(avg(j), 6) AS mean_bonus, count(grade) AS wins, round(count(grade) / count(*), 6) AS rate FROM ev GROUP BY strategy", lambda s, d: se.leaderboard(_settled(s, d)))
_COUNTED = "coalesce(string_agg(grade || ':' || c, ',' ORDER BY grade) FILTER (grade IS NOT NULL), '')"
_add(
    "l3_standings",
    SETTLED + f", k AS (SELECT *, row_number() OVER (PARTITION BY lottery, tier ORDER BY draw_date DESC, ticket_id, strategy, h, j) AS a FROM ev QUALIFY a <= 500), r AS (SELECT *, row_number() OVER (PARTITION BY lottery, tier, strategy ORDER BY a) AS s FROM k), w AS (SELECT lottery, tier, strategy, grade, count(*) AS c FROM k GROUP BY ALL), gr AS (SELECT lottery, tier, strategy, {_COUNTED} AS grades FROM w GROUP BY ALL), "
    "g AS (SELECT lottery, tier, strategy, count(*) AS tickets, round(avg(h), 6) AS mean_main, round(avg(j), 6) AS mean_bonus, round(avg(h + j), 6) AS mean_total, count(grade) AS wins, max(draw_date) AS last, round(avg(h + j) FILTER (s <= 10) - avg(h + j) FILTER (s BETWEEN 11 AND 20), 9) AS step FROM r GROUP BY ALL) "
    "SELECT lottery, tier AS domain, strategy, tickets, mean_main, mean_bonus, mean_total, wins, round(wins / tickets, 6) AS rate, grades, round(mean_main - 36.0::DOUBLE / 33, 6) AS edge, CASE WHEN step IS NULL THEN 'none' WHEN step > 0.15 THEN 'up' WHEN step < -0.15 THEN 'down' ELSE 'flat' END AS trend, last FROM g JOIN gr USING (lottery, tier, strategy)",
    lambda s, d: sd.standings(_settled(s, d)),
)
_add(
    "l2_sources",
    SETTLED + f", b AS (SELECT lottery, tier, strategy, grade, CASE WHEN grade > 2 THEN amount END AS amount FROM ev), c AS (SELECT lottery, tier, strategy, grade, count(*) AS c, coalesce(sum(amount), 0) AS money, count(*) FILTER (grade IS NOT NULL AND amount IS NULL) AS u FROM b GROUP BY CUBE (lottery, tier, strategy), grade) SELECT lottery, tier AS domain, strategy, sum(c)::BIGINT AS tickets, coalesce(sum(c) FILTER (grade IS NOT NULL), 0)::BIGINT AS wins, round(coalesce(sum(c) FILTER (grade IS NOT NULL), 0) / sum(c), 6) AS rate, {_COUNTED} AS grades, coalesce(sum(money) FILTER (grade IS NOT NULL), 0)::BIGINT AS prizes, sum(u)::BIGINT AS unknown FROM c GROUP BY ALL",
    lambda s, d: sd.prize_sources(_settled(s, d).withColumn("amount", F.expr("if(grade > 2, amount, null)"))),
)
_add("l6_search_hits", SETTLED + "SELECT ticket_id, h, j, grade, amount FROM settled WHERE h >= 2 AND amount >= 5 AND grade IS NOT NULL ORDER BY amount DESC, h DESC, ticket_id LIMIT 100", lambda s, d: se.search_hits(_settled(s, d), se.hit_filter({"main": 2}, least_amount=5), 100))
FOUND = "grade IS NOT NULL AND j >= 1 AND h >= 1 AND lottery IN ('g1', 'g2', 'g4') AND strategy IN ('A', 'R') AND draw_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND grade <= 6 AND amount >= 5"
_filter = lambda: se.hit_filter({"main": 1, "bonus": 1}, ["g1", "g2", "g4"], ["A", "R"], ("1996-01-01", "2000-12-31"), 6, 5)
_add("l6_by_date", SETTLED + f"SELECT ticket_id, h, j, grade, amount FROM settled WHERE {FOUND} ORDER BY draw_date DESC, amount DESC, h DESC, ticket_id LIMIT 50", lambda s, d: se.search_hits(_settled(s, d), _filter(), 50, "date"))
_add("l6_totals", SETTLED + f"SELECT count(*) AS tickets, count(grade) AS winners, count(*) FILTER ({FOUND}) AS matched, coalesce(sum(amount) FILTER ({FOUND}), 0)::BIGINT AS money, count(*) FILTER (grade IS NOT NULL AND amount IS NULL) AS unknown FROM ev", lambda s, d: se.search_totals(_settled(s, d), _filter()))
_add("l13_overlap", f"WITH {TICKETS}, x AS (SELECT a.batch, len(list_intersect(a.main, b.main)) AS x FROM tickets a JOIN tickets b ON a.batch = b.batch AND a.ticket_id < b.ticket_id), g AS (SELECT batch, count(*) AS pairs, avg(x) AS m, max(x) AS mx, avg((x > 2)::INT) AS c FROM x GROUP BY 1) SELECT batch, pairs, round(m, 6) AS mean_overlap, mx AS max_overlap, 1.090909::DOUBLE AS random_overlap, round(c, 6) AS clashing, round((1 + sqrt(1 + 8 * pairs)) / 2 / (1 + ((1 + sqrt(1 + 8 * pairs)) / 2 - 1) * m / 6), 6) AS effective FROM g", lambda s, d: se.overlap(br.tickets(s, d)))
_add(
    "m6_fields",
    f"WITH {SOURCES}, a AS (SELECT * FROM sources WHERE source = 'official' AND k % 19 <> 0), b AS (SELECT * FROM sources WHERE source = 'csv'), j AS (SELECT a.lottery, a.front AS af, b.front AS bf, a.back AS ab, b.back AS bb, a.sales AS s, b.sales AS t FROM a JOIN b USING (lottery, issue_year, issue_seq)), f AS (SELECT lottery, unnest([{{'field': 'front', 'st': CASE WHEN af = bf THEN 'agree' ELSE 'conflict' END}}, {{'field': 'back', 'st': CASE WHEN ab = bb THEN 'agree' ELSE 'conflict' END}}, {{'field': 'sales', 'st': CASE WHEN s IS NULL OR t IS NULL THEN 'skipped' WHEN (s = 0) <> (t = 0) THEN 'zero_side' WHEN abs(s - t) <= 1 THEN 'agree' ELSE 'conflict' END}}]) AS x FROM j) SELECT lottery, x.field AS field, count(*) FILTER (x.st <> 'skipped') AS checked, count(*) FILTER (x.st = 'agree') AS agree, count(*) FILTER (x.st = 'conflict') AS conflict, count(*) FILTER (x.st = 'zero_side') AS zero_side, count(*) FILTER (x.st = 'skipped') AS skipped FROM f GROUP BY 1, 2",
    lambda s, d: mg.reconcile_fields(br.sources(s, d).where("source <> 'official' or k % 19 <> 0"), "official", "csv"),
)


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


_add("l1_batches", "WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS st FROM events), y AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM x) SELECT user_id AS key, batch, count(*) AS n, min(ts) AS first, max(ts) AS last FROM y GROUP BY 1, 2", lambda s, d: se.batches(_events(s, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts"), 3600, "ts"))
_add(
    "l1_numbered",
    "WITH e AS (SELECT 'g' || (1 + user_id % 4) AS lottery, user_id // 4 AS issue, CASE WHEN event_id % 3 = 0 THEN 'B' || (user_id // 4) || '-' || event_type END AS batch_id, ts AS time FROM events), x AS (SELECT lottery, batch_id, arg_min(issue, (time, issue)) AS issue, 'explicit' AS kind, count(*) AS n, min(time) AS first, max(time) AS last FROM e WHERE batch_id IS NOT NULL GROUP BY 1, 2), "
    "t AS (SELECT *, CASE WHEN epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY lottery, issue ORDER BY time) <= 86400000000 THEN 0 ELSE 1 END AS st FROM e WHERE batch_id IS NULL), y AS (SELECT *, sum(st) OVER (PARTITION BY lottery, issue ORDER BY time ROWS UNBOUNDED PRECEDING) AS seq FROM t), z AS (SELECT lottery, 'D:' || lottery || ':' || issue || ':' || seq::BIGINT AS batch_id, issue, 'derived' AS kind, count(*) AS n, min(time) AS first, max(time) AS last FROM y GROUP BY lottery, issue, seq), "
    "u AS (SELECT * FROM x UNION ALL SELECT * FROM z) SELECT *, row_number() OVER (PARTITION BY lottery, issue ORDER BY first, batch_id) AS place, count(*) OVER (PARTITION BY lottery, issue) AS of FROM u",
    lambda s, d: se.numbered_batches(_events(s, d).select(F.expr("concat('g', 1 + user_id % 4)").alias("lottery"), F.expr("user_id div 4").alias("issue"), F.expr("if(event_id % 3 = 0, concat('B', user_id div 4, '-', event_type), null)").alias("batch_id"), F.col("ts").alias("time")), 86_400),
)
_add("x4_daily_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2", lambda s, d: jobs.daily_counts(_events(s, d)))

QUERIES |= more.QUERIES
ORACLES |= more.ORACLES

from . import deeper, fitted, tested, wider  # noqa: E402

QUERIES |= tested.QUERIES | wider.QUERIES | deeper.QUERIES | fitted.QUERIES
ORACLES |= tested.ORACLES | wider.ORACLES | deeper.ORACLES | fitted.ORACLES
