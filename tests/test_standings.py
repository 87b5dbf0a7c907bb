"""Standings, prize sources and numbered batches on small rows."""

import datetime as dt

from drawloom.operators import settle, standings

SETTLED = "lottery string, tier string, strategy string, ticket_id long, draw_date date, h int, j int, grade int, amount long, status string"


def _row(i, day, h, strategy="A", tier="p", grade=None, amount=None, status="evaluated"):
    return ("g", tier, strategy, i, dt.date(2020, 1, 1) + dt.timedelta(day), h, 0, grade, amount, status)


def test_a_ledger_looks_back_on_its_own(spark):
    rows = [_row(i, i, 1) for i in range(10)] + [_row(100 + i, 100 + i, 2, tier="r") for i in range(50)]
    got = {r.domain: r for r in standings.standings(spark.createDataFrame(rows, SETTLED), lookback=20).collect()}
    assert (got["p"].tickets, got["r"].tickets) == (10, 20)  # research rows push no production rows out
    assert got["p"].trend == "none" and got["r"].trend == "flat"  # none before the latest ten


def test_trend_and_grades(spark):
    rows = [_row(i, i, 0) for i in range(10)] + [_row(20 + i, 20 + i, 1 if i else 3, grade=None if i else 4, amount=None if i else 10) for i in range(10)]
    rows += [_row(40 + i, i, 1, "B") for i in range(10)] + [_row(60 + i, 20 + i, 0, "B") for i in range(9)] + [_row(99, 30, 6, "B", status="missed")]
    got = {r.strategy: r for r in standings.standings(spark.createDataFrame(rows, SETTLED)).collect()}
    assert (got["A"].trend, got["A"].grades, got["A"].wins, got["A"].rate) == ("up", "4:1", 1, 0.05)
    assert got["B"].trend == "down" and got["B"].tickets == 19 and got["B"].grades == ""


def test_prize_sources_count_what_is_unknown(spark):
    rows = [_row(1, 1, 6, grade=1), _row(2, 1, 3, grade=6, amount=5), _row(3, 1, 0, "B"), _row(4, 1, 0, None), _row(5, 1, 6, status="missed", grade=1)]
    got = {(r.lottery, r.domain, r.strategy): r for r in standings.prize_sources(spark.createDataFrame(rows, SETTLED)).collect()}
    whole = got[None, None, None]
    assert (whole.tickets, whole.wins, whole.prizes, whole.unknown, whole.grades) == (4, 2, 5, 1, "1:1,6:1")
    assert got["g", "p", "-"].tickets == 1 and got["g", None, "B"].prizes == 0
    assert standings.prize_sources(spark.createDataFrame([], SETTLED)).where("lottery is not null").count() == 0


def test_batches_of_both_kinds_are_numbered_together(spark):
    at = lambda s: None if s is None else dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    rows = [("g", 7, None, at(0)), ("g", 7, "", at(4)), ("g", 7, None, at(9)), ("g", 7, None, at(20)), ("g", 7, None, None), ("g", 7, "x", at(12)), ("g", 7, "x", at(500)), ("g", 8, None, None), ("h", 7, "x", at(1))]
    got = [tuple(r) for r in settle.numbered_batches(spark.createDataFrame(rows, "lottery string, issue int, batch_id string, time timestamp")).select("lottery", "issue", "place", "of", "batch_id", "n").orderBy("lottery", "issue", "place").collect()]
    assert got == [("g", 7, 1, 3, "D:g:7:1", 3), ("g", 7, 2, 3, "x", 2), ("g", 7, 3, 3, "D:g:7:2", 2), ("g", 8, 1, 1, "D:g:8:1", 1), ("h", 7, 1, 1, "x", 1)]
