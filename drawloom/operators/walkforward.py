"""Walk-forward fits: many expanding-window Poisson regressions at once, and where drawn combinations stand among all.

All cuts of all games are fitted together.  A Newton step is one pass over the
draws: each task adds up gradients and Hessians of every cut over its draws
before that cut; only those sums, some dozens a cut, reach the driver, where the
small systems are solved.
"""

from __future__ import annotations

from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resampling import block_means
from .universe import SHAPES, shape_counts, shapes

#: Rows that meet all cuts at once, and a linear predictor's bound.
ROWS, STEEP = 2048, 40.0


def _arrays(batch: pa.RecordBatch, width: int):
    """lottery, ord, y, offset and features of a batch as arrays."""
    at = {n: i for i, n in enumerate(batch.schema.names)}
    column = lambda n: batch.column(at[n])
    x = column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
    return np.array(column("lottery").to_pylist()), column("ord").to_numpy(), column("winners").to_numpy(), column("offset").to_numpy(), x


class Fits:
    """One Poisson regression a (lottery, from, cut): winners ~ exp(offset + x b) on draws from <= ord < cut."""

    def __init__(self, width: int, spans: dict[str, np.ndarray], scale: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.width, self.spans, self.scale = width, spans, scale
        self.beta = {g: np.zeros((len(s), width + 1)) for g, s in spans.items()}
        self.likelihood = {g: np.full(len(s), -np.inf) for g, s in spans.items()}
        self.null = {g: np.full(len(s), np.nan) for g, s in spans.items()}
        self.moments: dict[str, np.ndarray] = {}

    def design(self, game: str, x: np.ndarray) -> np.ndarray:
        mean, sd = self.scale[game]
        return np.concatenate([np.ones((len(x), 1)), (x - mean) / sd], 1)


def _pass(frame: DataFrame, fits: Fits, beta: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per game, a row of sums for each span: log-likelihood, gradient, upper Hessian, fitted moments."""
    p, upper = fits.width + 1, np.triu_indices(fits.width + 1)
    columns = 1 + p + len(upper[0]) + p

    def run(batches):
        sums = {g: np.zeros((len(s), columns)) for g, s in fits.spans.items()}
        for batch in batches:
            games, at, y, offset, raw = _arrays(batch, fits.width)
            for g in np.unique(games):
                if g not in sums:
                    continue
                rows = np.flatnonzero(games == g)
                for lo in range(0, len(rows), ROWS):
                    r = rows[lo : lo + ROWS]
                    x = fits.design(g, raw[r])
                    inside = (at[r][:, None] >= fits.spans[g][:, 0]) & (at[r][:, None] < fits.spans[g][:, 1])
                    eta = np.clip(x @ beta[g].T + offset[r][:, None], -STEEP, STEEP)
                    mu = np.exp(eta) * inside
                    left = y[r][:, None] * inside - mu
                    full = np.concatenate([np.ones((len(r), 1)), raw[r]], 1)
                    sums[g] += np.concatenate([(y[r][:, None] * inside * eta - mu).sum(0)[:, None], left.T @ x, mu.T @ (x[:, upper[0]] * x[:, upper[1]]), mu.T @ full], 1)
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * s.size), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["lottery", "place", "part"])

    got = frame.mapInArrow(run, "lottery string, place bigint, part double").groupBy("lottery", "place").agg(F.sum("part").alias("part"))
    out = {g: np.zeros(len(s) * columns) for g, s in fits.spans.items()}
    for r in got.toLocalIterator():
        out[r.lottery][r.place] = r.part
    return {g: v.reshape(-1, columns) for g, v in out.items()}


def fit_spans(frame: DataFrame, width: int, spans: dict[str, np.ndarray], rounds: int = 40, tolerance: float = 1e-9) -> Fits:
    """Maximum-likelihood fits of every span, by Newton steps that are halved while a likelihood falls.

    ``frame`` has lottery, ord, winners, offset and an array of features.  Fits
    are affine-invariant; features are centred by each game's own first span
    only to keep the systems well conditioned.  A span without winners keeps
    all coefficients at their start, far below.
    """
    p, upper = width + 1, np.triu_indices(width + 1)
    first = {g: s[np.argmin(s[:, 1])] for g, s in spans.items()}
    limits = F.create_map(*(F.lit(v) for g, s in first.items() for v in (g, int(s[1])))) if first else None
    scale = {}
    if first:
        early = frame.where(F.col("ord") < limits[F.col("lottery")])
        facts = early.select("lottery", F.posexplode("features").alias("at", "x")).groupBy("lottery", "at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
        for g in spans:
            own = sorted((r.at, r.m, r.s) for r in facts if r.lottery == g)
            scale[g] = (np.array([m for _, m, _ in own]), np.array([s if s and s > 0 else 1.0 for _, _, s in own]))
    spans = {g: s for g, s in spans.items() if len(scale.get(g, ((),))[0]) == width}
    fits = Fits(width, spans, scale)
    beta = {g: b.copy() for g, b in fits.beta.items()}
    start = {}
    for step in range(rounds):
        sums = _pass(frame, fits, beta)
        moving = 0.0
        for g, s in sums.items():
            if step == 0:  # the intercept alone: fitted and observed totals agree
                total, fitted = s[:, 1] + s[:, 1 + p + len(upper[0])], s[:, 1 + p + len(upper[0])]
                beta[g][:, 0] = np.log(np.maximum(total, 1e-9) / np.maximum(fitted, 1e-300))
                moving = np.inf
                continue
            if step == 1:
                fits.null[g] = s[:, 0].copy()
            hessian = np.zeros((len(s), p, p))
            hessian[:, upper[0], upper[1]] = s[:, 1 + p : 1 + p + len(upper[0])]
            hessian = hessian + np.triu(hessian, 1).transpose(0, 2, 1)
            hessian += 1e-9 * np.trace(hessian, axis1=1, axis2=2)[:, None, None] * np.eye(p) + 1e-12 * np.eye(p)
            worse = s[:, 0] < fits.likelihood[g] - 1e-9 * (1 + np.abs(fits.likelihood[g]))
            better = ~worse
            fits.beta[g][better], fits.likelihood[g][better] = beta[g][better], s[better, 0]
            fits.moments.setdefault(g, np.zeros((len(s), p)))[better] = s[better, 1 + p + len(upper[0]) :]
            move = np.linalg.solve(hessian, s[:, 1 : 1 + p, None])[:, :, 0]
            start.setdefault(g, np.zeros_like(move))
            start[g] = np.where(worse[:, None], start[g] / 2, move)
            beta[g] = fits.beta[g] + start[g]
            moving = max(moving, float(np.abs(start[g]).max(initial=0)))
        if moving < tolerance:
            break
    return fits


def sold(draws: DataFrame) -> DataFrame:
    """lottery, ord, k, winners, offset (log of the tickets sold) and the sorted numbers of every draw with sales."""
    from .order import with_order

    return with_order(draws.where("sales > 0")).select("lottery", "ord", "k", F.col("first_winners").cast("double").alias("winners"), F.ln(F.col("sales") / 2).alias("offset"), F.array_sort(F.col("front").cast("array<bigint>")).alias("front"))


def _shapes_of(front: pa.Array) -> np.ndarray:
    """SHAPES of a column of sorted numbers, one row each."""
    return shapes(front.flatten().to_numpy(zero_copy_only=False).reshape(len(front), -1)) if len(front) else np.zeros((0, len(SHAPES)))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def shape_frame(draws: DataFrame) -> DataFrame:
    """lottery, ord, k, winners, offset (log of the tickets sold) and the array of SHAPES of every draw with sales."""

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            made = _lists(_shapes_of(batch.column(at["front"])))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in ("lottery", "ord", "k", "winners", "offset")), made], ["lottery", "ord", "k", "winners", "offset", "features"])

    return sold(draws).mapInArrow(run, "lottery string, ord bigint, k bigint, winners double, offset double, features array<double>")


def expanding_cuts(frame: DataFrame, min_train: int, step: int) -> dict[str, np.ndarray]:
    """Per game the spans (1, cut) of every refit: cuts follow each other by ``step`` draws, from ``min_train`` earlier draws on."""
    tops = {r.lottery: r.n for r in frame.groupBy("lottery").agg(F.max("ord").alias("n")).collect()}
    return {g: np.array([(1, c) for c in range(min_train + 1, n + 1, step)], np.int64).reshape(-1, 2) for g, n in tops.items() if n > min_train}


#: Cuts that one task fits.
CUTS = 64


def _cells(frame: DataFrame, min_train: int, step: int) -> DataFrame:
    """(lottery, cuts, range, at, features, y, t, o): all that expanding fits need, by ``range`` of ``CUTS`` cuts and different features.

    The likelihood of draws with equal features depends on their winners, the
    sum of their tickets and of winners times offset alone.  ``at`` 0 holds
    those of all draws before the range's first cut, ``at`` i what is added
    until its cut i; a draw is there once, and each range's start once for all
    different features seen until then.
    """
    tops = frame.groupBy("lottery").agg(F.max("ord").alias("n")).where(F.col("n") > min_train)
    tops = F.broadcast(tops.select("lottery", F.expr(f"(n - {min_train} - 1) div {step} + 1").alias("cuts")))  # one row a game
    segment = F.when(F.col("ord") <= min_train, F.lit(0)).otherwise(F.expr(f"(ord - {min_train} - 1) div {step} + 1"))
    sums = [F.sum(c).alias(c) for c in ("y", "t", "o")]
    d = frame.select("lottery", segment.cast("bigint").alias("segment"), "features", F.col("winners").alias("y"), F.exp("offset").alias("t"), (F.col("winners") * F.col("offset")).alias("o"))
    d = d.join(tops, "lottery").where("segment < cuts").groupBy("lottery", "cuts", "segment", "features").agg(*sums)
    key = ["lottery", "cuts", "range", "at", "features", "y", "t", "o"]
    added = d.where(f"segment % {CUTS} <> 0").withColumns({"range": F.expr(f"segment div {CUTS}"), "at": F.expr(f"segment % {CUTS}")}).select(*key)
    bins = d.groupBy("lottery", "cuts", "features", F.expr(f"(segment + {CUTS - 1}) div {CUTS}").alias("range")).agg(*sums).where(f"range <= (cuts - 1) div {CUTS}")
    every = bins.groupBy("lottery", "cuts", "features").agg(F.min("range").alias("first")).withColumn("range", F.explode(F.sequence(F.col("first"), F.expr(f"(cuts - 1) div {CUTS}")))).drop("first")
    upto = Window.partitionBy("lottery", "features").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    met = every.join(bins, ["lottery", "cuts", "features", "range"], "left")
    before = met.select("lottery", "cuts", "range", F.lit(0).cast("bigint").alias("at"), "features", *(F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(c) for c in ("y", "t", "o")))
    return before.select(*key).unionByName(added)


def _newton(x: np.ndarray, raw: np.ndarray, y: np.ndarray, t: np.ndarray, o: np.ndarray, rounds: int = 40, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and fitted moments of one Poisson regression a row of ``y`` (winners), ``t`` (tickets) and ``o``, all over the feature vectors ``x``; ``fit_spans`` on cells."""
    p, upper = x.shape[1], np.triu_indices(x.shape[1])
    product = lambda a, b: np.einsum("ij,jk->ik", a, b)  # no threads of its own beside those of other tasks
    squares = x[:, upper[0]] * x[:, upper[1]]
    beta = np.zeros((len(y), p))
    beta[:, 0] = np.log(np.maximum(y.sum(1), 1e-9) / np.maximum(t.sum(1), 1e-300))
    best, top, move, moments, calm = beta.copy(), np.full(len(y), -np.inf), np.zeros_like(beta), np.zeros_like(beta), 0
    for _ in range(rounds):
        eta = np.clip(product(beta, x.T), -2 * STEEP, 2 * STEEP)
        mu = np.exp(eta) * t
        likelihood = (y * eta + o - mu).sum(1)
        worse = likelihood < top - 1e-9 * (1 + np.abs(top))
        better = ~worse
        best[better], top[better], moments[better] = beta[better], likelihood[better], product(mu, raw)[better]
        hessian = np.zeros((len(y), p, p))
        hessian[:, upper[0], upper[1]] = product(mu, squares)
        hessian = hessian + np.triu(hessian, 1).transpose(0, 2, 1)
        hessian += 1e-9 * np.trace(hessian, axis1=1, axis2=2)[:, None, None] * np.eye(p) + 1e-12 * np.eye(p)
        step = np.linalg.solve(hessian, product(y - mu, x)[:, :, None])[:, :, 0]
        move = np.where(worse[:, None], move / 2, step)
        beta = best + move
        calm += float(np.abs(move).max(initial=0)) < tolerance
        if calm > 1:  # a last step more: sums over long histories are wanted to their last digits
            break
    return best, moments


def expanding_fits(frame: DataFrame, min_train: int, step: int) -> tuple[DataFrame, dict]:
    """(lottery, cut, beta, moments) of the fits before every cut, and each game's scale: mean and deviation of the features of its first ``min_train`` draws.

    A task fits a range of cuts over the different feature vectors, so the work
    grows with cuts times those and not with cuts times draws; no fit passes
    through the driver.
    """
    early = frame.where(F.col("ord") <= min_train)
    facts = early.select("lottery", F.posexplode("features").alias("at", "x")).groupBy("lottery", "at").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    scale = {}
    for g in {r.lottery for r in facts}:
        own = sorted((r.at, r.m, r.s) for r in facts if r.lottery == g)
        scale[g] = (np.array([m for _, m, _ in own]), np.array([s if s and s > 0 else 1.0 for _, _, s in own]))

    def fitted(part: pa.Table) -> pa.Table:
        g, first = part.column("lottery")[0].as_py(), part.column("range")[0].as_py() * CUTS
        many = min(CUTS, part.column("cuts")[0].as_py() - first)
        flat = part.column("features").combine_chunks().flatten().to_numpy().reshape(len(part), -1)
        vectors, which = np.unique(flat, axis=0, return_inverse=True)
        sums = np.zeros((3, many, len(vectors)))
        for i, c in enumerate(("y", "t", "o")):
            np.add.at(sums[i], (part.column("at").to_numpy(), which.ravel()), part.column(c).to_numpy())
        ones = np.ones((len(vectors), 1))
        beta, moments = _newton(np.concatenate([ones, (vectors - scale[g][0]) / scale[g][1]], 1), np.concatenate([ones, vectors], 1), *sums.cumsum(1))
        lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
        return pa.table({"lottery": pa.array([g] * many), "cut": pa.array(min_train + 1 + (first + np.arange(many)) * step), "beta": lists(beta), "moments": lists(moments)})

    return _cells(frame, min_train, step).groupBy("lottery", "range").applyInArrow(fitted, "lottery string, cut bigint, beta array<double>, moments array<double>"), scale


def walk_forward_fits(draws: DataFrame, min_train: int, step: int) -> DataFrame:
    """(lottery, cut, feature, moment) of the popularity model refitted before every cut on earlier draws only.

    The moments are the fitted totals of winners and of winners times each
    feature.  At a maximum they equal the observed ones; that is the score
    equation.
    """
    fits, _ = expanding_fits(shape_frame(draws), min_train, step)
    named = F.arrays_zip(F.array(*(F.lit(n) for n in ("winners", *SHAPES))).alias("feature"), F.col("moments").alias("moment"))
    return fits.select("lottery", "cut", F.explode(named).alias("m")).select("lottery", "cut", F.col("m")["feature"].alias("feature"), F.col("m")["moment"].alias("moment"))


#: Equal ranges of scores that outcomes are counted by.
RANGES = 16_384


def _scored(z: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The linear scores of feature vectors, one a column of ``z``, in whole billionths."""
    s = np.einsum("i,ij->j", b, z)
    s *= 1e9
    return np.rint(s, out=s)


def _midranks(z: np.ndarray, c: np.ndarray, asked: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the mid-rank of each vector of ``asked`` by score among the ``c`` outcomes of each of ``z``.

    Nothing is sorted whole: scores are counted by ranges between the least and
    the greatest asked, and only those in a range with an asked one are compared.
    """
    if not np.isfinite(b).all():  # no scores: all are equal
        return np.full(asked.shape[1], c.sum())
    s, every = _scored(asked, b), _scored(z, b)
    low, high = s.min(), s.max()
    scale = (RANGES - 1) / (high - low) if high > low else 0.0

    def place(v: np.ndarray) -> np.ndarray:  # never falls along v
        x = v - low
        x *= scale
        np.clip(x, -1, RANGES, out=x)
        x += 1
        return x.astype(np.intp)

    mine, at = place(s), place(every)
    near = np.zeros(RANGES + 2, bool)
    near[mine] = True
    sums = np.bincount(at, c, RANGES + 2)
    sums[near] = 0
    close = np.flatnonzero(near.take(at))
    close = close[np.argsort(every[close])]
    upto, close = np.concatenate([[0], np.cumsum(c[close])]), every[close]
    return 2 * np.cumsum(sums)[mine] + upto[np.searchsorted(close, s, side="left")] + upto[np.searchsorted(close, s, side="right")]


def _sums(winners: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a draw adds to a cell of equal features: winners, tickets, winners times offset."""
    return winners, np.exp(offset), winners * offset


def _starts(rows: DataFrame, last: dict[str, int]) -> DataFrame:
    """(lottery, block, features, y, t, o): the sums of all draws of earlier blocks by their features, for each block up to the game's ``last``.

    ``rows`` are sold draws with their block.  Sums go on unchanged until the
    next block that has draws with these features.
    """

    def summed(part: pa.Table) -> pa.Table:
        vectors, which = np.unique(_shapes_of(part.column("front").combine_chunks()), axis=0, return_inverse=True)
        made = [np.bincount(which.ravel(), v, len(vectors)) for v in _sums(part.column("winners").to_numpy(), part.column("offset").to_numpy())]
        key = [pa.array([part.column(n)[0].as_py()] * len(vectors), part.schema.field(n).type) for n in ("lottery", "block")]
        return pa.table([*key, _lists(vectors), *map(pa.array, made)], ["lottery", "block", "features", "y", "t", "o"])

    bins = rows.groupBy("lottery", "block").applyInArrow(summed, "lottery string, block bigint, features array<double>, y double, t double, o double")
    w = Window.partitionBy("lottery", "features").orderBy("block")  # one row a block
    end = F.create_map(*(F.lit(v) for g, n in last.items() for v in (g, n)))[F.col("lottery")] if last else F.lit(-1)
    upto = bins.select("lottery", "block", "features", *(F.sum(c).over(w).alias(c) for c in ("y", "t", "o")), F.lead("block").over(w).alias("next"), end.cast("bigint").alias("last")).where("block < last")
    return upto.select("lottery", F.explode(F.sequence(F.col("block") + 1, F.coalesce("next", "last"))).alias("block"), "features", "y", "t", "o")


def walk_forward_quantiles(draws: DataFrame, min_train: int, step: int, n: int = 33, k: int = 6) -> DataFrame:
    """(lottery, ord, k, cut, u): the mid-rank of each drawn combination's popularity among all C(n, k), by a model of strictly earlier draws.

    Each draw after the first ``min_train`` is scored by the last refit before
    it.  The universe is counted by its feature vectors; a task fits ``CUTS``
    cuts over the sums of all earlier draws and its own, scores the universe
    under one cut after the other, and ranks each cut's ``step`` draws in it.
    Games with ``min_train`` draws or fewer give no rows.
    """
    spark = draws.sparkSession
    numbered = sold(draws)
    scale, last = {}, {}
    early = F.collect_list(F.when(F.col("ord") <= min_train, F.col("front")))  # min_train rows a game
    for r in numbered.groupBy("lottery").agg(F.max("ord").alias("n"), early.alias("early")).collect():
        x = shapes(np.array(r.early, np.int64))
        scale[r.lottery], last[r.lottery] = (x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)), (r.n - min_train - 1) // (step * CUTS)
    # the draws that a block of cuts ranks; all before the first cut are block -1.  Both readers need all columns, so the rows are shuffled once
    rows = numbered.withColumn("block", F.when(F.col("ord") <= min_train, F.lit(-1)).otherwise(F.expr(f"(ord - {min_train} - 1) div {step * CUTS}")).cast("bigint"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lottery", "block")  # else few small partitions would do all the ranking
    # the universe by feature vectors: its size is the game's, whatever the number of draws
    table = shape_counts(spark, n, k).toArrow()
    universe = spark.sparkContext.broadcast((table.column(0).combine_chunks().flatten().to_numpy().reshape(-1, len(SHAPES)), table.column(1).to_numpy().astype(np.float64)))

    def ranked(part: pa.Table, start: pa.Table) -> pa.Table:
        kept = ["lottery", "ord", "k"]
        if not len(part) or part.column("block")[0].as_py() < 0:
            return part.slice(0, 0).select(kept).append_column("cut", pa.array([], pa.int64())).append_column("u", pa.array([], pa.float64()))
        x, c = universe.value
        mean, sd = scale[part.column("lottery")[0].as_py()]
        first = min_train + 1 + part.column("block")[0].as_py() * step * CUTS
        own, at = _shapes_of(part.column("front").combine_chunks()), (part.column("ord").to_numpy() - first) // step
        many = int(at.max()) + 1
        before = start.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(SHAPES))
        vectors, which = np.unique(np.concatenate([before, own]), axis=0, return_inverse=True)
        which, later = which.ravel(), at + 1 < many  # a cut's draws are known to the next one
        sums = np.zeros((3, many, len(vectors)))
        for total, name, new in zip(sums, ("y", "t", "o"), _sums(part.column("winners").to_numpy(), part.column("offset").to_numpy()), strict=True):
            np.add.at(total[0], which[: len(before)], start.column(name).to_numpy())
            np.add.at(total, (at[later] + 1, which[len(before) :][later]), new[later])
        ones = np.ones((len(vectors), 1))
        beta, _ = _newton(np.concatenate([ones, (vectors - mean) / sd], 1), np.concatenate([ones, vectors], 1), *sums.cumsum(1))
        columns = lambda v: np.ascontiguousarray(((v - mean) / sd).T)
        every, drawn, u = columns(x), columns(own), np.empty(len(part))
        for i in range(many):
            asked = np.flatnonzero(at == i)
            u[asked] = _midranks(every, c, drawn[:, asked], beta[i, 1:])
        return part.select(kept).append_column("cut", pa.array(first + at * step)).append_column("u", pa.array(np.round(u / (2 * c.sum()), 9)))

    starts = _starts(rows, last)
    return rows.groupBy("lottery", "block").cogroup(starts.groupBy("lottery", "block")).applyInArrow(ranked, "lottery string, ord bigint, k bigint, cut bigint, u double")


def quantile_test(quantiles: DataFrame, block: int, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(lottery, n, mean, se, lo, hi, z, ks, ks_p): whether drawn combinations stand in the middle on average.

    The standard error and the 95 % interval come from a block bootstrap of
    ``block`` draws; ``ks`` is the largest distance from the uniform
    distribution, with its asymptotic tail.
    """
    from .order import rank_by_parts

    quantiles = quantiles.select("lottery", "ord", "u").persist()  # four readers, and each would fit and rank all draws anew
    boot = block_means(quantiles.select("lottery", "ord", F.col("u").alias("x")), block, replicates, seed)
    ranked = rank_by_parts(quantiles, ["lottery"], F.floor(F.col("u") * 256), ["u", "ord"], "place")
    total = quantiles.groupBy("lottery").agg(F.count(F.lit(1)).alias("n"))
    far = ranked.join(F.broadcast(total), "lottery").groupBy("lottery").agg(F.max(F.greatest(F.col("place") / F.col("n") - F.col("u"), F.col("u") - (F.col("place") - 1) / F.col("n"))).alias("ks"))  # one row a game
    out = []
    spark = quantiles.sparkSession
    ks = {r.lottery: r.ks for r in far.collect()}
    for r in boot.collect():
        t = (sqrt(r.n) + 0.12 + 0.11 / sqrt(r.n)) * ks[r.lottery]
        tail = min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * float(np.exp(-2 * i * i * t * t)) for i in range(1, 101)))) if t > 0.2 else 1.0
        z = (r.mean - 0.5) / r.se if r.se else None
        out.append((r.lottery, r.n, round(r.mean, 6), r.se, r.lo, r.hi, z, erfc(abs(z) / sqrt(2)) if z is not None else None, ks[r.lottery], tail))
    quantiles.unpersist()
    return spark.createDataFrame(out, "lottery string, n bigint, mean double, se double, lo double, hi double, z double, p double, ks double, ks_p double")


def cross_validation(frame: DataFrame, width: int, folds: int = 5, flips: int = 2000, seed: int = 1) -> DataFrame:
    """(lottery, fold, n, gain, total, p): out-of-fold log-likelihood gained over the model without features, on expanding windows.

    Fold f is predicted by a fit on all draws before it.  ``p`` is one-sided:
    how often random signs of the draws' gains, blocks of them, reach the total.
    """
    tops = {r.lottery: r.n for r in frame.groupBy("lottery").agg(F.max("ord").alias("n")).collect()}
    edges = {g: [1 + n * i // (folds + 1) for i in range(1, folds + 2)] for g, n in tops.items() if n >= 4 * (folds + 1)}
    fits = fit_spans(frame, width, {g: np.array([(1, e) for e in cut[:-1]], np.int64) for g, cut in edges.items()})
    rates = {}
    listed = [(g, i, int(e)) for g, cut in edges.items() for i, e in enumerate(cut[:-1])]
    if not listed:
        return frame.sparkSession.createDataFrame([], "lottery string, fold int, n bigint, gain double, total double, p double")
    cuts = F.broadcast(frame.sparkSession.createDataFrame(listed, "lottery string, fold int, cut bigint"))  # folds a game
    for r in frame.join(cuts, "lottery").where(F.col("ord") < F.col("cut")).groupBy("lottery", "fold").agg(F.sum("winners").alias("y"), F.sum(F.exp("offset")).alias("t")).collect():
        rates[(r.lottery, r.fold)] = float(np.log(max(r.y, 1e-9) / r.t))
    shared = frame.sparkSession.sparkContext.broadcast((fits.beta, fits.scale, edges, rates))

    def gains(batches):
        beta, scale, edges, rates = shared.value
        for batch in batches:
            lottery, order, y, offset, x = _arrays(batch, width)
            for g in np.unique(lottery):
                if g not in edges:
                    continue
                rows = np.flatnonzero((lottery == g) & (order >= edges[g][0]))
                fold = np.clip(np.searchsorted(edges[g], order[rows], side="right") - 1, 0, len(edges[g]) - 2)
                z = np.concatenate([np.ones((len(rows), 1)), (x[rows] - scale[g][0]) / scale[g][1]], 1)
                with_ = np.clip((z * beta[g][fold]).sum(1) + offset[rows], -STEEP, STEEP)
                without = np.array([rates[(g, int(f))] for f in fold]) + offset[rows]
                gain = y[rows] * (with_ - without) - np.exp(with_) + np.exp(without)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(rows), pa.string()), pa.array(order[rows]), pa.array(fold.astype(np.int32)), pa.array(gain)], ["lottery", "ord", "fold", "gain"])

    each = frame.mapInArrow(gains, "lottery string, ord bigint, fold int, gain double").persist()
    per = each.groupBy("lottery", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"))
    from .resampling import sign_flips

    p = sign_flips(each.select("lottery", "ord", F.col("gain").alias("x")), flips, seed)
    return per.join(F.broadcast(p), "lottery").select("lottery", (F.col("fold") + 1).alias("fold"), "n", "gain", "total", "p")  # one row a game


def halves_drift(frame: DataFrame, width: int) -> DataFrame:
    """(lottery, chi2, df, p, ratio): whether a game's coefficients differ between the halves of its draws.

    ``chi2`` is twice the log-likelihood that two fits have over one; ``ratio``
    is winners of the second half over what the first half's fit expects there.
    """
    tops = {r.lottery: r.n for r in frame.groupBy("lottery").agg(F.max("ord").alias("n")).collect()}
    spans = {g: np.array([(1, n // 2 + 1), (n // 2 + 1, n + 1), (1, n + 1)], np.int64) for g, n in tops.items() if n >= 4 * (width + 1)}
    fits = fit_spans(frame, width, spans)
    first = {g: np.concatenate([b[:1], b[:1], b[:1]]) for g, b in fits.beta.items()}
    there = _pass(frame, fits, first)
    from ..functions import special

    at = 1 + width + 1 + (width + 1) * (width + 2) // 2
    rows = [(g, float(2 * (f[0] + f[1] - f[2])), width + 1, float(fits.moments[g][1, 0] / there[g][1, at])) for g, f in fits.likelihood.items()]
    out = frame.sparkSession.createDataFrame(rows, "lottery string, chi2 double, df int, ratio double")
    return out.select("lottery", F.round("chi2", 6).alias("chi2"), "df", special.chi2_sf("chi2", F.col("df").cast("double")).alias("p"), F.round("ratio", 6).alias("ratio"))
