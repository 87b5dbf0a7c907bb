from datetime import date

from pyspark.sql import functions as F

from drawloom.sources import files


def test_csv_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("期号,红球1,红球2,蓝球1,总投注额(元),开奖日期\n2024001,1,2,3,\"1,234\",03/01/2024\n24002,#,9,4,#,#\n".encode("gbk"))
    (tmp_path / "b.csv").write_bytes("﻿期号,开奖日期,号码1,号码2,号码3\n07001,2007-02-03,0,9,4\n".encode())
    a = [tuple(r) for r in files.read_draw_csv(spark, str(tmp_path / "a.csv"), "x", "GBK").select("issue_year", "issue_seq", "front", "back", "sales", "draw_date").collect()]
    assert a == [(2024, 1, [1, 2], [3], 1234, date(2024, 1, 3)), (2024, 2, [None, 9], [4], None, None)]
    b = files.read_draw_csv(spark, str(tmp_path / "b.csv"), "y").first()
    assert (b.lottery, b.issue_year, b.issue_seq, b.front, b.draw_date) == ("y", 2007, 1, [0, 9, 4], date(2007, 2, 3))


def test_market_upsert(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "lottery string, issue string, source string, sales long")
    files.write_market(make([("a", "1", "s", 1), ("b", "1", "s", 2), ("a", "1", "s", 1)]), str(tmp_path), "draw")
    files.write_market(make([("a", "1", "s", 9), ("a", "2", "s", 3)]), str(tmp_path), "draw")
    got = sorted(tuple(r) for r in files.read_market(spark, str(tmp_path), "draw").select("lottery", "issue", "sales").collect())
    assert got == [("a", "1", 9), ("a", "2", 3), ("b", "1", 2)]


def test_ledger_round_trip_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "l")
    files.write_ledger_jsonl(spark.createDataFrame([(5, None, "x")], "cost int, note string, issue string"), path, ["issue", "cost"])
    text = next(p for p in (tmp_path / "l").glob("*.json") if p.stat().st_size).read_text()
    assert text.strip() == '{"issue":"x","cost":5,"note":null}'
    (tmp_path / "m.json").write_text('{"issue":"x","cost":5}\nnot json\n')
    good, bad = files.read_ledger_jsonl(spark, str(tmp_path / "m.json"), "issue string, cost int")
    assert [tuple(r) for r in good.collect()] == [("x", 5)] and bad.count() == 1


def test_pending_tickets(spark):
    df = spark.createDataFrame([("b1", '[{"strategy":"hot","numbers":[1,2]},{"strategy":"cold","numbers":[3]}]'), ("b2", None), ("b3", "[]")], "batch string, tickets string")
    got = [(r.batch, r.batch_size, r.seq, r.ticket.strategy, r.ticket.numbers) for r in files.explode_pending(df, "strategy string, numbers array<int>").collect()]
    assert got == [("b1", 2, 1, "hot", [1, 2]), ("b1", 2, 2, "cold", [3])]


def test_export_leaves_wrong_draws_out(spark, tmp_path):
    rows = [("g", 2024, 2, [1, 2, 3], [4]), ("g", 2024, 1, [5, 6, 7], [8]), ("g", 2024, 3, [1, 1, 2], [4]), ("g", 2024, 4, [1, 2, 3], [3]), ("g", 2024, 5, [1, 2], [4])]
    df = spark.createDataFrame(rows, "lottery string, issue_year int, issue_seq int, front array<int>, back array<int>").withColumn("draw_date", F.lit("2024-01-01")).withColumn("sales", F.lit(1))
    out = files.export_csv(df, str(tmp_path / "e"), 3, 9, 1, 9)
    assert sorted((r.issue_seq, r.errors) for r in out.collect()) == [(3, ["repeat"]), (4, ["shared"]), (5, ["count"])]
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "e")).select("issue_seq", "n1", "n3", "b1").collect()] == [("1", "5", "7", "8"), ("2", "1", "3", "4")]
