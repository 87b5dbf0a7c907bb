"""Running totals and drawdowns over many stretches against a plain loop."""

import random

import pytest

from drawloom.operators import order
from drawloom.operators.settle import drawdown


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_drawdown_is_that_of_a_plain_loop(spark, monkeypatch, stretch):
    monkeypatch.setattr(order, "STRETCH", stretch)
    rng = random.Random(stretch)
    nets = {"up": [1.5] * 20, "down": [-2.0] * 20, "flat": [0.0] * 9, "one": [-1.0], "mixed": [rng.choice([-2.0, -2.0, 0.1, 3.0, 8.25]) for _ in range(60)], "late": [-1.0] * 25 + [30.0] + [-0.5] * 10}
    want = {}
    for game, values in nets.items():
        total = peak = worst = last = longest = 0
        for i, v in enumerate(values, 1):
            total = round(total + v, 4)
            peak = max(peak, total)
            worst = max(worst, round(peak - total, 4))
            last = i if total == peak else last
            longest = max(longest, i - last)
            want[game, i] = (total, peak, round(peak - total, 4), worst, i - last, longest)
    rows = [(g, i, v, i) for g, values in nets.items() for i, v in enumerate(values, 1)]
    out = drawdown(spark.createDataFrame(rows, "lottery string, ord long, net double, at long"))
    assert set(out.columns) == {"lottery", "net", "at", "running", "peak", "drawdown", "worst", "under", "longest_under"}
    assert {(r.lottery, r.at): (r.running, r.peak, r.drawdown, r.worst, r.under, r.longest_under) for r in out.collect()} == want


def test_drawdown_of_no_rows(spark):
    assert drawdown(spark.createDataFrame([], "lottery string, ord long, net double, at long")).count() == 0
