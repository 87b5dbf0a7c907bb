"""The driver's tables seen as draws, sources, tickets and regional winners, in Spark and in SQL.

Orders are draws, line items are tickets for the draw of their order, customers'
nations are the regions of winners.  Integer arithmetic only, so that both
engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import REGIONS, parse_region_text
from ..operators.order import rank_by_parts

_STRIDES = "1, 2, 4, 5, 7, 8, 10, 13, 14, 16"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, lottery, issue_year, issue_seq, draw_date, sales, first_winners, front (6 of 33), back (1 of 16)."""
    o = _table(spark, sf_dir, "orders")
    d = o.select(
        F.expr("concat('g', cast(o_orderkey % 4 + 1 as string))").alias("lottery"), F.year("o_orderdate").cast("bigint").alias("issue_year"), F.col("o_orderkey").alias("k"), "o_orderdate",
        F.to_date("o_orderdate").alias("draw_date"), (F.floor("o_totalprice") * 100).cast("bigint").alias("sales"), F.expr("o_custkey % 12").alias("first_winners"),
        F.expr(f"array_sort(transform(sequence(0, 5), i -> 1 + ((o_orderkey * 13 + o_custkey * 5) % 33 + i * element_at(array({_STRIDES}), cast(1 + o_custkey % 10 as int))) % 33))").alias("front"),
        F.expr("array(1 + (o_orderkey * 7 + o_custkey) % 16)").alias("back"),
    )
    return rank_by_parts(d, ["lottery", "issue_year"], F.col("draw_date"), ["o_orderdate", "k"], "issue_seq").drop("o_orderdate")


DRAWS = f"""d0 AS (SELECT *, 'g' || CAST(o_orderkey % 4 + 1 AS VARCHAR) AS lottery, CAST(year(o_orderdate) AS BIGINT) AS issue_year, (o_orderkey * 13 + o_custkey * 5) % 33 AS k0, [{_STRIDES}][1 + o_custkey % 10] AS st FROM orders),
draws AS (SELECT lottery, issue_year, row_number() OVER (PARTITION BY lottery, issue_year ORDER BY o_orderdate, o_orderkey) AS issue_seq, o_orderkey AS k, CAST(o_orderdate AS DATE) AS draw_date,
  CAST(floor(o_totalprice) AS BIGINT) * 100 AS sales, o_custkey % 12 AS first_winners, list_sort([1 + (k0 + i * st) % 33 for i in [0, 1, 2, 3, 4, 5]]) AS front, [1 + (o_orderkey * 7 + o_custkey) % 16] AS back FROM d0)"""


def five(seq) -> Column:
    """A year's issue number as text of five digits, or of all it has."""
    text = F.col(seq).cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(5)), "0")


FIVE = "lpad(CAST(issue_seq AS VARCHAR), greatest(length(CAST(issue_seq AS VARCHAR)), 5)::INTEGER, '0')"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws as three sources report them, the third with wrong, zero and missing sales."""
    d = draws(spark, sf_dir)
    seq = five("issue_seq")
    official = d.select("*", F.lit("official").alias("source"), F.concat(F.col("issue_year").cast("string"), seq).alias("issue"))
    agg = d.where("k % 3 <> 0").select("*", F.lit("agg").alias("source"), F.concat(F.col("issue_year").cast("string"), seq).alias("issue"))
    # two-digit year and three digits where they do
    short = F.when(F.col("issue_seq") < 1000, F.concat(F.substring(F.col("issue_year").cast("string"), 3, 2), F.lpad(F.col("issue_seq").cast("string"), 3, "0"))).otherwise(F.concat(F.col("issue_year").cast("string"), seq))
    bad = F.when(F.col("k") % 13 == 0, None).when(F.col("k") % 11 == 0, F.lit(0)).when(F.col("k") % 7 == 0, F.col("sales") + 100).otherwise(F.col("sales"))
    csv = d.where("k % 5 <> 0").withColumn("sales", bad).select("*", F.lit("csv").alias("source"), short.alias("issue"))
    return official.unionByName(agg).unionByName(csv)


SOURCES = (
    DRAWS
    + f""",
sources AS (SELECT *, 'official' AS source, CAST(issue_year AS VARCHAR) || {FIVE} AS issue FROM draws
  UNION ALL SELECT *, 'agg', CAST(issue_year AS VARCHAR) || {FIVE} FROM draws WHERE k % 3 <> 0
  UNION ALL SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN sales + 100 ELSE sales END AS sales), 'csv', CASE WHEN issue_seq < 1000 THEN substr(CAST(issue_year AS VARCHAR), 3, 2) || lpad(CAST(issue_seq AS VARCHAR), 3, '0') ELSE CAST(issue_year AS VARCHAR) || {FIVE} END FROM draws WHERE k % 5 <> 0)"""
)


def full_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sources`` with pool, draw order and region text as far as each has them; some official draws twice, under two issue texts."""
    d = sources(spark, sf_dir)
    short = d.where("source = 'official' and k % 9 = 0").withColumn("issue", F.expr("concat('P', issue_seq)")).withColumn("sales", F.col("sales") + 1)
    pool = F.expr("case when source = 'official' and k % 4 = 0 or k % 8 = 0 then null else k * 1000 + length(source) end")
    seq = F.expr("case when source = 'official' then null when source = 'agg' and k % 5 = 1 then '' else array_join(if(source = 'csv', front, reverse(front)), ',') end")
    text = F.expr("case when source = 'official' then null when k % 7 = 0 then '' else concat(source, k % 25) end")
    return d.unionByName(short).withColumns({"pool": pool, "seq": seq, "region_text": text})


FULL = (
    SOURCES
    + """,
twice AS (SELECT * FROM sources UNION ALL SELECT * REPLACE ('P' || issue_seq AS issue, sales + 1 AS sales) FROM sources WHERE source = 'official' AND k % 9 = 0),
full_sources AS (SELECT *, CASE WHEN (source = 'official' AND k % 4 = 0) OR k % 8 = 0 THEN NULL ELSE k * 1000 + length(source) END AS pool,
  CASE WHEN source = 'official' THEN NULL WHEN source = 'agg' AND k % 5 = 1 THEN '' ELSE array_to_string(CASE WHEN source = 'csv' THEN front ELSE list_reverse(front) END, ',') END AS seq,
  CASE WHEN source = 'official' THEN NULL WHEN k % 7 = 0 THEN '' ELSE source || (k % 25) END AS region_text FROM twice)"""
)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket_id, batch, draw_k, main (6 of 33), bonus, strategy, tier, score, generated."""
    li = _table(spark, sf_dir, "lineitem")
    return li.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("ticket_id"), F.col("l_orderkey").alias("batch"), F.when(F.expr("l_partkey % 9 <> 0"), F.col("l_orderkey")).alias("draw_k"),
        F.expr(f"array_sort(transform(sequence(0, 5), i -> 1 + (l_partkey % 33 + i * element_at(array({_STRIDES}), cast(1 + l_suppkey % 10 as int))) % 33))").alias("main"),
        F.expr("array(1 + l_partkey % 16)").alias("bonus"), F.col("l_returnflag").alias("strategy"), F.col("l_linestatus").alias("tier"), F.col("l_discount").alias("score"), F.col("l_shipdate").alias("generated"),
    )


TICKETS = f"""tickets AS (SELECT l_orderkey * 10 + l_linenumber AS ticket_id, l_orderkey AS batch, CASE WHEN l_partkey % 9 <> 0 THEN l_orderkey END AS draw_k,
  list_sort([1 + (l_partkey % 33 + i * [{_STRIDES}][1 + l_suppkey % 10]) % 33 for i in [0, 1, 2, 3, 4, 5]]) AS main, [1 + l_partkey % 16] AS bonus, l_returnflag AS strategy, l_linestatus AS tier, l_discount AS score, l_shipdate AS generated FROM lineitem)"""


def prize_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lottery, issue_year, issue_seq, region, winners."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    who = o.select(F.col("o_orderkey").alias("k"), "o_custkey").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(F.broadcast(n.select("n_nationkey", F.col("n_name").alias("region"))), "n_nationkey")
    return draws(spark, sf_dir).select("k", "lottery", "issue_year", "issue_seq", "sales").join(who.select("k", "region", F.expr("1 + o_custkey % 3").alias("winners")), "k").drop("k")


WINNERS = DRAWS + """,
prize_regions AS (SELECT d.lottery, d.issue_year, d.issue_seq, d.sales, n.n_name AS region, 1 + o.o_custkey % 3 AS winners FROM draws d JOIN orders o ON o.o_orderkey = d.k JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws as five digits each, with first and second winners and whether an award ran."""
    o = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.expr("transform(sequence(0, 4), i -> ((o_orderkey * 7919 + o_custkey * 104729) % 100000) div element_at(array(1, 10, 100, 1000, 10000), i + 1) % 10)").alias("digits"),
        F.expr("o_custkey % 12").alias("winners1"), F.expr("50 + o_custkey % 97").alias("winners2"), F.expr("o_orderkey % 9 = 0").alias("award"),
        F.expr(f"transform(sequence(0, 5), i -> 1 + ((o_orderkey * 13 + o_custkey * 5) % 33 + i * element_at(array({_STRIDES}), cast(1 + o_custkey % 10 as int))) % 33)").alias("seq"),
        F.expr("5000000 + o_orderkey % 1000 * 1000").alias("prize1"), F.expr("100000 + o_custkey % 1000 * 100").alias("prize2"), F.expr("cast(floor(o_totalprice) as bigint) * 5000").alias("pool"),
    )
    return draws(spark, sf_dir).join(o, "k")


SERIES = (
    DRAWS
    + """,
series AS (SELECT d.*, [((o_orderkey * 7919 + o_custkey * 104729) % 100000) // p % 10 FOR p IN [1, 10, 100, 1000, 10000]] AS digits, o_custkey % 12 AS winners1, 50 + o_custkey % 97 AS winners2, o_orderkey % 9 = 0 AS award, [1 + ((o_orderkey * 13 + o_custkey * 5) % 33 + i * [1, 2, 4, 5, 7, 8, 10, 13, 14, 16][1 + o_custkey % 10]) % 33 FOR i IN [0, 1, 2, 3, 4, 5]] AS seq, 5000000 + o_orderkey % 1000 * 1000 AS prize1, 100000 + o_custkey % 1000 * 100 AS prize2, floor(o_totalprice)::BIGINT * 5000 AS pool FROM draws d JOIN orders ON o_orderkey = k)"""
)


_NAMES = ", ".join(f"'{r}'" for r in REGIONS)


def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lottery, k, issue_year, issue_seq, region_text: winners of two regions as sources write them, in brackets, with a breakdown, empty or missing."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("o_custkey").alias("c"))
    t = F.expr(
        f"""case when k % 13 = 0 then null when k % 11 = 0 then ''
            when k % 5 = 0 then concat(element_at(array({_NAMES}), cast(1 + c % 25 as int)), '(基本', 1 + c % 3, '注 追加1注)、', element_at(array({_NAMES}), cast(1 + (c + k) % 32 as int)), '（基本', k % 4, ' 注）。')
            else concat(element_at(array({_NAMES}), cast(1 + c % 25 as int)), 1 + c % 3, '注，', element_at(array({_NAMES}), cast(1 + (c + k) % 32 as int)), k % 4, '注，', if(k % 6 = 0, '积分换彩1注，', ''), '共', 1 + c % 3 + k % 4 + if(k % 6 = 0, 1, 0), '注。', if(k % 7 = 0, concat('其中', element_at(array({_NAMES}), cast(1 + c % 25 as int)), '9注'), '')) end"""
    )
    return draws(spark, sf_dir).select("lottery", "k", "issue_year", "issue_seq").join(o.select("k", t.alias("region_text")), "k")


TEXTS = (
    DRAWS
    + f""",
rn AS (SELECT [{_NAMES}] AS names),
rt AS (SELECT d.lottery, d.k, d.issue_year, d.issue_seq, o_custkey AS c, names[1 + o_custkey % 25] AS r1, 1 + o_custkey % 3 AS w1, names[1 + (o_custkey + k) % 32] AS r2, k % 4 AS w2, k % 13 <> 0 AND k % 11 <> 0 AS said FROM draws d JOIN orders ON o_orderkey = k, rn),
parsed AS (SELECT lottery, k, region, sum(w)::BIGINT AS winners FROM (SELECT lottery, k, r1 AS region, w1 AS w FROM rt WHERE said UNION ALL SELECT lottery, k, r2, w2 FROM rt WHERE said AND w2 > 0) GROUP BY ALL)"""
)


def stored_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lottery, k, source, region, winners as stored: of most draws from one source, of some from two, some changed."""
    t = region_texts(spark, sf_dir).select("lottery", "k", F.explode(parse_region_text(F.col("region_text"))).alias("r")).select("lottery", "k", "r.region", F.col("r.winners").cast("bigint").alias("winners"))
    kept = t.where("k % 3 <> 0").withColumn("winners", F.when(F.expr("k % 37 = 0"), F.col("winners") + 2).otherwise(F.col("winners")))
    return kept.withColumn("source", F.lit("zh")).unionByName(kept.where("k % 23 = 0").withColumn("source", F.lit("cw")))


STORED = (
    TEXTS
    + """,
st0 AS (SELECT lottery, k, region, winners + CASE WHEN k % 37 = 0 THEN 2 ELSE 0 END AS winners FROM parsed WHERE k % 3 <> 0),
stored AS (SELECT *, 'zh' AS source FROM st0 UNION ALL SELECT *, 'cw' FROM st0 WHERE k % 23 = 0),
prizes AS (SELECT lottery, k, source, 1 AS level, winners FROM (SELECT lottery, k, 'official' AS source, w1 + w2 + CASE WHEN k % 6 = 0 AND k % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN k % 10 = 1 THEN 1 WHEN k % 17 = 0 THEN -1 ELSE 0 END AS winners FROM rt WHERE k % 19 <> 0 UNION ALL SELECT lottery, k, 'agg', w1 - 1 FROM rt WHERE k % 19 <> 0) UNION ALL SELECT lottery, k, 'csv', 2, 99 FROM rt UNION ALL SELECT lottery, k, 'csv', 1, 0 FROM rt WHERE k % 19 = 0 AND k % 2 = 0)"""
)


def first_prizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lottery, k, source, level, winners: first-prize winners as sources state them, some too low or too high, some missing."""
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr("o_custkey").alias("c"))
    d = draws(spark, sf_dir).select("lottery", "k").join(o, "k")
    row = lambda where, source, level, winners: d.where(where).select("lottery", "k", F.lit(source).alias("source"), F.lit(level).alias("level"), F.expr(winners).cast("bigint").alias("winners"))
    official = "1 + c % 3 + k % 4 + if(k % 6 = 0 and k % 5 <> 0, 1, 0) + case when k % 10 = 1 then 1 when k % 17 = 0 then -1 else 0 end"
    return row("k % 19 <> 0", "official", 1, official).unionByName(row("k % 19 <> 0", "agg", 1, "c % 3")).unionByName(row("true", "csv", 2, "99")).unionByName(row("k % 19 = 0 and k % 2 = 0", "csv", 1, "0"))


def region_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ym, region (the customer's nation), agency (the order's status), sales."""
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    who = o.select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(F.broadcast(n.select("n_nationkey", F.col("n_name").alias("region"))), "n_nationkey")
    return who.groupBy(F.date_format("o_orderdate", "yyyyMM").alias("ym"), "region", F.col("o_orderstatus").alias("agency")).agg(F.sum(F.floor("o_totalprice")).cast("bigint").alias("sales"))


SALES = """region_sales AS (SELECT strftime(o_orderdate, '%Y%m') AS ym, n_name AS region, o_orderstatus AS agency, sum(floor(o_totalprice))::BIGINT AS sales FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)"""
