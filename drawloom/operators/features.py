"""Features of every draw from strictly earlier draws, and views as of a draw."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draw_stats import arrays, past_counts, windowed, with_lead
from .order import by, by_stretches, stretched, with_order


@cache
def _share(part: int, whole: int) -> float:
    """``part`` / ``whole`` to six decimals, halves away from zero as SQL rounds."""
    return float(Decimal(repr(part / whole)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if whole else float("nan")


def _shares(parts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """``_share`` of whole numbers, worked out once for each different pair."""
    code, back = np.unique(np.asarray(whole, np.int64) * 2**32 + 2**31 + parts, return_inverse=True)
    return np.array([_share(int(c % 2**32) - 2**31, int(c // 2**32)) for c in code.tolist()], np.float64)[back].reshape(np.broadcast(parts, whole).shape)


def _matrix(draws: DataFrame, size: int, widths: dict[str, int], more) -> DataFrame:
    """(lottery, ord, freq, gap, shares, label, ...) of the draws with ``widths["counts"]`` draws before them; ``more`` gives further columns from the counts by width."""
    width = widths["counts"]
    d = with_lead(draws, widths)
    odd, low = np.arange(1, size + 1) % 2 == 1, np.arange(1, size + 1) <= size // 2
    thirds = [(np.arange(1, size + 1) > k * size // 3) & (np.arange(1, size + 1) <= (k + 1) * size // 3) for k in range(3)]
    extra = list(more({n: np.zeros((0, size), np.int64) for n in widths}))

    def work(table: pa.Table) -> dict[str, pa.Array]:
        own, there, counts, gaps = windowed(table, size, widths)
        full = table["ord"].to_numpy()[own] > width
        own, there, gaps, counts = own[full], there[full], gaps[full], {n: c[full] for n, c in counts.items()}
        c = counts["counts"]
        whole = c.sum(1)
        shares = _shares(np.stack([c[:, x].sum(1) for x in (odd, low, *thirds)], 1), whole[:, None]).ravel()
        kept = table.take(pa.array(own)).combine_chunks()
        out = {"lottery": kept["lottery"], "ord": kept["ord"], "freq": arrays(_shares(c, width)), "gap": arrays(_shares(gaps, width))}
        out["shares"] = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * 5), pa.array(shares, mask=np.isnan(shares)))
        return out | {"label": arrays(there.astype(np.int32))} | {n: arrays(v) for n, v in more(counts).items()}

    blank = {n: "array<double>" for n in ("freq", "gap", "shares")} | {"label": "array<int>"} | {n: "array<double>" for n in extra}
    return by_stretches(d, work, d.select("lottery", "ord", *(F.lit(None).cast(k).alias(n) for n, k in blank.items())).schema)


def feature_matrix_v1(draws: DataFrame, size: int, width: int) -> DataFrame:
    """(lottery, ord, freq, gap, shares, label) of every draw with ``width`` draws before it.

    freq and gap are a number's count and its draws unseen within the window,
    over ``width``; shares are those of odd and low numbers and of the thirds;
    label says which numbers the draw itself has.
    """
    return _matrix(draws, size, {"counts": width}, lambda counts: {})


def feature_matrix_v2(draws: DataFrame, size: int, width: int) -> DataFrame:
    """v1 with each number's counts in the last 10 and 30 draws over those, and the slope: its count in the later half of the window less that in the earlier, over ``width``.

    All windows come from one pass; ``width`` is at least 30.
    """
    if width < 30:
        raise ValueError("the window must hold at least 30 draws")
    more = lambda c: {"freq10": _shares(c["c10"], 10), "freq30": _shares(c["c30"], 30), "slope": _shares(2 * c["half"] - c["counts"], width)}
    return _matrix(draws, size, {"counts": width, "c10": 10, "c30": 30, "half": width // 2}, more)


def number_cells(draws: DataFrame, size: int, width: int, splits: int = 3) -> DataFrame:
    """(lottery, block, freq, gap, label, rows): how many numbers of the draws of each of ``splits`` + 1 equal blocks have the same freq, gap and label of ``feature_matrix_v1``.

    Counts and gaps are whole numbers up to ``width``, so the rows are few
    whatever the number of draws; a stretch counts its own before they are shuffled.
    """
    n = draws.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))
    d = with_lead(draws, {"counts": width}).join(F.broadcast(n), "lottery")  # one row a game

    def work(table: pa.Table) -> dict[str, pa.Array]:
        own, there, counts, gaps = windowed(table, size, {"counts": width})
        ord = table["ord"].to_numpy()[own]
        full = ord > width
        step = (table["n"][0].as_py() - width) / (splits + 1)
        block = sum(((ord >= width + 1 + step * k).astype(np.int64) for k in range(1, splits + 1)), np.zeros(len(ord), np.int64))
        code = ((block[:, None] * (width + 1) + counts["counts"]) * (width + 1) + gaps) * 2 + there
        code, rows = np.unique(code[full], return_counts=True)
        at = np.unravel_index(code, (splits + 1, width + 1, width + 1, 2))
        return {"lottery": pa.array([table["lottery"][0].as_py()] * len(code), pa.string())} | {n: pa.array(x, pa.int64()) for n, x in zip(("block", "count", "gap", "label", "rows"), (*at, rows), strict=True)}

    made = by_stretches(d, work, "lottery string, block long, count long, gap long, label long, rows long")
    g = made.groupBy("lottery", "block", "count", "gap", "label").agg(F.sum("rows").alias("rows"))
    return g.select("lottery", "block", F.round(F.col("count") / width, 6).alias("freq"), F.round(F.col("gap") / width, 6).alias("gap"), "label", "rows")


def quantile_of(values: Column, q: float) -> Column:
    """Interpolated quantile of a short array, in any order; null if it is empty."""
    s = F.array_sort(values)
    at = (F.size(s) - 1) * q
    lo = F.floor(at).cast("int")
    return F.when(F.size(s) > 0, F.get(s, lo) + (F.get(s, F.least(lo + 1, F.size(s) - 1)) - F.get(s, lo)) * (at - lo))


def pit_view(series: DataFrame, last: int = 8) -> DataFrame:
    """What is known before each draw: the pool left by the draw before, and median, P10 and P90 of the last ``last`` positive sales."""
    d = stretched(with_order(series).select("lottery", "ord", "pool", "sales"), last)
    recent = F.collect_list(F.when(F.col("sales") > 0, F.col("sales"))).over(by().rowsBetween(-last, -1))  # at most ``last`` values
    d = d.select("lottery", "ord", "lead", F.lag("pool").over(by()).alias("pool_before"), recent.alias("r")).where("not lead")
    return d.select("lottery", "ord", "pool_before", *(F.round(quantile_of(F.col("r"), q), 4).alias(n) for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))))


def train_test_gap(draws: DataFrame, size: int, width: int, choose: int) -> DataFrame:
    """Per game: mean hits of the hot ticket on the ``width`` draws it was made from and on the next, and their relative gap."""
    from .series import _top

    counts = past_counts(draws, size, width).where(F.col("ord") > width)
    order = F.array_sort(F.transform("counts", lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    inside = F.aggregate(F.slice(order, 1, choose), F.lit(0).cast("bigint"), lambda a, x: a - x["c"]) / width
    d = counts.select("lottery", "ord", inside.alias("inside")).join(_top(counts, F.col("counts"), choose).select("lottery", "ord", "hits"), ["lottery", "ord"])
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.avg("inside").alias("a"), F.avg("hits").alias("b"))
    return g.select("lottery", "n", F.round("a", 6).alias("inside"), F.round("b", 6).alias("outside"), F.round((F.col("a") - F.col("b")) / (F.col("a") + F.col("b")), 6).alias("gap"))


def pool_calibration(series: DataFrame, cap: float) -> DataFrame:
    """Per game over draws with winners: median of winners times prize over the pool before, and the share of draws at the cap."""
    from .order import medians

    d = stretched(with_order(series).select("lottery", "ord", "pool", "winners1", "prize1"), 1).withColumn("before", F.lag("pool").over(by())).where("not lead and winners1 > 0 and before > 0")
    d = d.withColumn("x", F.round(F.col("winners1") * F.col("prize1") / F.col("before"), 9))
    g = d.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prize1") >= cap).cast("int")), 6).alias("at_cap"))
    return g.join(medians(d, ["lottery"], "x"), "lottery").select("lottery", "n", "at_cap", F.round("middle", 6).alias("paid"))

