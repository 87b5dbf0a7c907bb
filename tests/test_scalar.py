from datetime import date

from pyspark.sql import functions as F

from drawloom.functions import scalar


def test_issue_keys(spark):
    df = spark.createDataFrame([("2026120",), ("26120",), ("07001",), ("3001",), ("junk",), (None,)], "t string")
    got = [tuple(r.k) if r.k else None for r in df.select(scalar.issue_key(F.col("t")).alias("k")).collect()]
    assert got == [(2026, 120), (2026, 120), (2007, 1), (2003, 1), None, None]


def test_dates_and_money(spark):
    df = spark.createDataFrame([("3/1/2024", "1,234.6"), ("2024-01-03", "，"), ("20240103", None), ("#", "7")], "d string, m string")
    rows = df.select(scalar.parse_draw_date(F.col("d")).alias("d"), scalar.to_int_money(F.col("m")).alias("m")).collect()
    assert [r.d for r in rows] == [date(2024, 1, 3)] * 3 + [None]
    assert [r.m for r in rows] == [1235, None, None, 7]


def test_tax_limits(spark):
    df = spark.createDataFrame([(9999.0,), (10000.0,), (10001.0,)], "g double")
    assert [round(r.t, 4) for r in df.select(scalar.tax(F.col("g")).alias("t")).collect()] == [0, 0, 2000.2]


def test_masks_count_common_numbers(spark):
    df = spark.createDataFrame([([1, 5, 33], [5, 33, 2]), ([], [1])], "a array<int>, b array<int>")
    assert [r.h for r in df.select(scalar.zone_hits(scalar.number_mask(F.col("a")), scalar.number_mask(F.col("b"))).alias("h")).collect()] == [2, 0]


def test_shapes(spark):
    df = spark.createDataFrame([([1, 2, 3, 13, 23, 33],)], "f array<int>")
    r = df.select(*(c.alias(n) for n, c in scalar.shape_features(F.col("f")).items())).first()
    assert (r.total, r.span, r.pairs, r.longest_run, r.tail_repeats) == (75, 32, 2, 3, 6)


def test_region_text_is_read_once(spark):
    d = spark.createDataFrame([("广东3注，广东1注，北京2注，共6注。",)], "t string").select(scalar.parse_region_text(F.col("t")).alias("r"))
    assert [tuple(r) for r in d.first().r] == [("广东", 4), ("北京", 2)]
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2
