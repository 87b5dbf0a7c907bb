"""Maximum likelihood from aggregated statistics: the heat of digits by position, and shares of the pool cut off at a cap.

What the likelihood needs of the draws is aggregated first (cells of equal
digits, sums of logarithms); every step of a fit is one pass over those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A step of the fit changes no logit by more.
LONGEST = 2.0


def heat_statistics(series: DataFrame, tiers: list[str], positions: int, values: int) -> DataFrame:
    """(lottery, position, digit, tier, draws, winners): how often each digit came and what each tier won there.

    Draws with no digits, too few or too large ones are left out; missing
    winners count neither as draws nor as winners of their tier.
    """
    ok = (F.size("digits") >= positions) & F.forall("digits", lambda d: d.isNotNull() & (d >= 0) & (d < values))
    each = series.where(ok).select("lottery", F.posexplode(F.slice("digits", 1, positions)).alias("position", "digit"), F.array(*(F.col(t).cast("bigint") for t in tiers)).alias("w"))
    long = each.select("lottery", "position", "digit", F.posexplode("w").alias("tier", "w")).where("w is not null")
    return long.groupBy("lottery", "position", "digit", (F.col("tier") + 1).alias("tier")).agg(F.count(F.lit(1)).alias("draws"), F.sum("w").alias("winners"))


def heat_cells(series: DataFrame, tiers: list[str], positions: int, values: int) -> DataFrame:
    """(lottery, digits, volume, known, unknown): all that the likelihood needs of draws with equal digits.

    ``volume`` are the tickets of draws that state their sales, ``known`` the
    winners by tier of those and ``unknown`` of the others.  Draws that lack
    the winners of a tier are left out.
    """
    ok = (F.size("digits") >= positions) & F.forall("digits", lambda d: d.isNotNull() & (d >= 0) & (d < values))
    w = [F.col(t).cast("double") for t in tiers]
    whole = F.lit(True)
    for c in w:
        whole = whole & c.isNotNull()
    sold = F.coalesce(F.col("sales") > 0, F.lit(False))
    part = lambda c, own: F.sum(F.when(F.col("_ok") & own, c).otherwise(0.0))
    # what ``digits`` are made of may come from a join; a filter on them would be pushed into joins that lack their columns, so faulty draws go after the aggregation
    d = series.where(whole).withColumns({"_ok": F.coalesce(ok, F.lit(False)), "digits": F.slice("digits", 1, positions)})
    cells = d.groupBy("lottery", F.transform("digits", lambda x: x.cast("int")).alias("digits")).agg(
        part(F.col("sales") / 2, sold).alias("volume"), F.array(*(part(c, sold) for c in w)).alias("known"), F.array(*(part(c, ~sold) for c in w)).alias("unknown"), F.count_if("_ok").alias("_good")
    )
    return cells.where("_good > 0").drop("_good")


class Heat:
    """Digit shares by position and a volume factor a tier; tier t is won by all but t - 1 positions."""

    def __init__(self, positions: int, values: int, tiers: int):
        self.positions, self.values, self.tiers = positions, values, tiers
        self.free = positions * (values - 1)
        self.size = self.free + tiers

    def shares(self, theta: np.ndarray) -> np.ndarray:
        logits = np.concatenate([theta[: self.free].reshape(self.positions, -1), np.zeros((self.positions, 1))], 1)
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def chances(self, theta: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, tiers) chances times the tier's factor, and the slopes of their logarithms in all parameters."""
        pi = self.shares(theta)
        m = np.clip(pi[np.arange(self.positions), digits], 1e-12, 1 - 1e-12)
        cells = len(digits)
        # chance of exactly j misses, and its slope in each position's chance
        miss = np.zeros((cells, self.tiers + 1))
        miss[:, 0] = 1.0
        slope = np.zeros((cells, self.positions, self.tiers))
        for i in range(self.positions):
            miss[:, 1 : self.tiers] = miss[:, 1 : self.tiers] * m[:, [i]] + miss[:, : self.tiers - 1] * (1 - m[:, [i]])
            miss[:, 0] = miss[:, 0] * m[:, i]
        for i in range(self.positions):
            others = np.zeros((cells, self.tiers))
            others[:, 0] = 1.0
            for j in range(self.positions):
                if j != i:
                    others[:, 1:] = others[:, 1:] * m[:, [j]] + others[:, :-1] * (1 - m[:, [j]])
                    others[:, 0] = others[:, 0] * m[:, j]
            slope[:, i] = others
            slope[:, i, 1:] -= others[:, :-1]
        q = np.maximum(miss[:, : self.tiers], 1e-300)
        grad = np.zeros((cells, self.tiers, self.size))
        for i in range(self.positions):
            hot = (digits[:, [i]] == np.arange(self.values - 1)).astype(float) - pi[i, None, :-1]  # slope of ln m in the logits
            at = slice(i * (self.values - 1), (i + 1) * (self.values - 1))
            grad[:, :, at] = (slope[:, i] * m[:, [i]] / q)[:, :, None] * hot[:, None, :]
        grad[:, np.arange(self.tiers), self.free + np.arange(self.tiers)] = 1.0
        return q * np.exp(theta[self.free :]), grad

    def sums(self, theta: np.ndarray, digits: np.ndarray, volume: np.ndarray, known: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """Log-likelihood, score and expected information of cells, as one row.

        Where the volume is not known it is replaced by the value that fits best
        given the shares, so only how the winners spread over the tiers counts.
        """
        q, grad = self.chances(theta, digits)
        mean = volume[:, None] * q
        total = unknown.sum(1)
        p = q / q.sum(1, keepdims=True)
        likelihood = (known * np.log(np.maximum(mean, 1e-300)) * (known > 0) - mean).sum() + (unknown * np.log(p)).sum()
        away = grad - (p[:, :, None] * grad).sum(1, keepdims=True)
        score = ((known - mean)[:, :, None] * grad).sum((0, 1)) + (unknown[:, :, None] * away).sum((0, 1))
        flat, far = (grad * np.sqrt(mean)[:, :, None]).reshape(-1, self.size), (away * np.sqrt(total[:, None] * p)[:, :, None]).reshape(-1, self.size)
        information = flat.T @ flat + far.T @ far
        return np.concatenate([[likelihood], score, information[np.triu_indices(self.size)]])


def position_heat_poisson(series: DataFrame, tiers: list[str], positions: int = 5, values: int = 10, rounds: int = 60, tolerance: float = 1e-4) -> DataFrame:
    """(lottery, position, digit, share, score): the shares of tickets on each digit at each position, by maximum likelihood.

    Winners of tier t are Poisson with mean volume * factor_t * (chance that a
    ticket misses exactly t - 1 positions); the volume is sales / 2 where sales
    are known and fitted draw by draw where not.  A factor a tier takes what
    the price or other rules change in its level.  Games are fitted together:
    a step is one pass over all cells.  ``score`` is the slope of the
    likelihood in the digit's logit (0 at the maximum; the last digit of each
    position is the reference and has 0); the fit goes on until no slope is
    over ``tolerance``, however many winners there are.  A small pull towards
    equal shares (one winner's worth) keeps digits that never came finite.
    """
    spark = series.sparkSession
    model = Heat(positions, values, len(tiers))
    cells = heat_cells(series, tiers, positions, values).persist()
    games = sorted(r.lottery for r in cells.select("lottery").distinct().collect())
    upper = np.triu_indices(model.size)
    width = 1 + model.size + len(upper[0])

    def passed(theta: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def run(batches):
            made: dict[str, np.ndarray] = {}
            for batch in batches:
                lottery = np.array(batch.column(0).to_pylist())
                digits, known, unknown = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for i in (1, 3, 4))
                volume = batch.column(2).to_numpy()
                for g in np.unique(lottery):
                    mine = np.flatnonzero(lottery == g)
                    for lo in range(0, len(mine), 1024):
                        r = mine[lo : lo + 1024]
                        made[g] = made.get(g, 0) + model.sums(theta[g], digits[r], volume[r], known[r], unknown[r])
            for g, s in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([g] * width), pa.array(np.arange(width)), pa.array(s)], ["lottery", "place", "part"])

        out = {g: np.zeros(width) for g in theta}
        for r in cells.select("lottery", "digits", "volume", "known", "unknown").mapInArrow(run, "lottery string, place bigint, part double").groupBy("lottery", "place").agg(F.sum("part").alias("part")).toLocalIterator():
            out[r.lottery][r.place] = r.part
        return out

    pull = np.concatenate([np.ones(model.free), np.zeros(model.tiers)])
    best = {g: np.zeros(model.size) for g in games}
    top, move, score = {g: -np.inf for g in games}, {g: np.zeros(model.size) for g in games}, {g: np.zeros(model.size) for g in games}
    asked = {g: t.copy() for g, t in best.items()}
    for _ in range(rounds if games else 0):
        for g, s in passed(asked).items():
            likelihood = s[0] - (pull * asked[g] ** 2).sum() / 2
            if likelihood >= top[g] - 1e-9 * (1 + abs(top[g])):
                best[g], top[g] = asked[g], likelihood
                information = np.zeros((model.size, model.size))
                information[upper] = s[1 + model.size :]
                information += np.triu(information, 1).T + np.diag(pull + 1e-9)
                score[g] = s[1 : 1 + model.size] - pull * best[g]
                move[g] = np.linalg.solve(information, score[g])
                move[g] *= min(1.0, LONGEST / max(np.abs(move[g]).max(), 1e-12))
            else:
                move[g] = move[g] / 2
            asked[g] = best[g] + move[g]
        if max(np.abs(v).max() for v in score.values()) < tolerance:
            break
    cells.unpersist()
    rows = []
    for g in games:
        pi = model.shares(best[g])
        at = np.concatenate([score[g][: model.free].reshape(positions, -1), np.zeros((positions, 1))], 1)
        rows += [(g, i, v, float(pi[i, v]), float(at[i, v])) for i in range(positions) for v in range(values)]
    return spark.createDataFrame(rows, "lottery string, position int, digit int, share double, score double")


# ---------------------------------------------------------------------------
# Shares of the pool, cut off at a cap
# ---------------------------------------------------------------------------


def censored_sums(rows: DataFrame) -> DataFrame:
    """(lottery, uncapped, capped, s1, s2): of positive ``x`` with ``capped``: how many, and the sums of ln x and its square over the uncapped."""
    d = rows.where("x > 0").withColumn("l", F.ln("x"))
    free = lambda c: F.coalesce(F.sum(F.when(~F.col("capped"), c)), F.lit(0.0))
    return d.groupBy("lottery").agg(F.count_if(~F.col("capped")).alias("uncapped"), F.count_if("capped").alias("capped"), free(F.col("l")).alias("s1"), free(F.col("l") * F.col("l")).alias("s2"))


def _tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the normal distribution's upper tail, and its density over that tail."""
    tail = np.array([math.erfc(v / math.sqrt(2)) / 2 for v in np.minimum(z, 30.0)])
    far = z > 30
    log = np.where(far, -z * z / 2 - np.log(np.maximum(z, 1.0) * math.sqrt(2 * math.pi)), np.log(np.maximum(tail, 1e-300)))
    return log, np.where(far, z + 1 / np.maximum(z, 1.0), np.exp(-np.minimum(z, 30.0) ** 2 / 2) / math.sqrt(2 * math.pi) / np.maximum(tail, 1e-300))


def censored_lognormal(rows: DataFrame, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(lottery, uncapped, capped, mu, sigma, median): a log-normal distribution of ``x`` where ``capped`` values are only known to be that or more.

    Newton steps in the mean and the logarithm of the deviation, for all games
    together: the uncapped draws count by three sums, the capped ones by six
    that each step adds up in one pass over them.  Fewer than two different
    uncapped values have no sigma, and a mean only if nothing is capped; a game
    without any usable value has no row.
    """
    spark = rows.sparkSession
    facts = {r.lottery: r for r in censored_sums(rows).collect()}
    ends = rows.where("capped and x > 0").select("lottery", F.ln("x").alias("l")).persist()
    theta, fitted = {}, {}
    for g, r in facts.items():
        n = r.uncapped
        spread = r.s2 / n - (r.s1 / n) ** 2 if n else 0.0
        if n < 2 or spread <= 1e-12:
            fitted[g] = (r.s1 / n if n and not r.capped else None, None)
        else:
            theta[g] = np.array([r.s1 / n, 0.5 * math.log(spread)])

    def passed(at: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        def run(batches):
            made: dict[str, np.ndarray] = {}
            for batch in batches:
                lottery, l = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy()
                for g in np.unique(lottery):
                    if g in at:
                        z = (l[lottery == g] - at[g][0]) / math.exp(at[g][1])
                        log, h = _tails(z)
                        d = h * (h - z)
                        made[g] = made.get(g, 0) + np.array([log.sum(), h.sum(), (z * h).sum(), d.sum(), (z * d).sum(), (z * z * d).sum()])
            for g, s in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), *(pa.array([v]) for v in s)], ["lottery", *"abcdef"])

        got = ends.mapInArrow(run, "lottery string, a double, b double, c double, d double, e double, f double").groupBy("lottery").agg(*(F.sum(c).alias(c) for c in "abcdef"))
        return {r.lottery: np.array(r[1:]) for r in got.collect()}

    best, top, move = dict(theta), {g: -np.inf for g in theta}, {}
    asked = dict(theta)
    for _ in range(rounds if theta else 0):
        sums, moving = passed(asked), 0.0
        for g, at in asked.items():
            r, (mu, log_sigma) = facts[g], at
            n, v = r.uncapped, math.exp(2 * log_sigma)
            tail, h, zh, d, zd, zzd = sums.get(g, np.zeros(6))
            square = r.s2 - 2 * mu * r.s1 + n * mu * mu
            likelihood = -n * log_sigma - square / (2 * v) + tail
            if likelihood >= top[g] - 1e-12 * (1 + abs(top[g])):
                best[g], top[g] = at, likelihood
                s = math.sqrt(v)
                slope = np.array([(r.s1 - n * mu) / v + h / s, -n + square / v + zh])
                cross = -2 * (r.s1 - n * mu) / v - (zd + h) / s
                curve = np.array([[n / v + d / v, -cross], [-cross, 2 * square / v + zh + zzd]])
                low = np.linalg.eigvalsh(curve)[0]
                step = np.linalg.solve(curve + max(0.0, 1e-9 - low) * np.eye(2), slope)
                move[g] = step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
            else:
                move[g] = move[g] / 2
            asked[g] = best[g] + move[g]
            moving = max(moving, float(np.abs(move[g]).max()))
        if moving < tolerance:
            break
    ends.unpersist()
    fitted |= {g: (float(t[0]), math.exp(t[1])) for g, t in best.items()}
    out = [(g, r.uncapped, r.capped, *fitted[g], math.exp(fitted[g][0]) if fitted[g][0] is not None else None) for g, r in facts.items()]
    return spark.createDataFrame(out, "lottery string, uncapped bigint, capped bigint, mu double, sigma double, median double")


def paid_shares(series: DataFrame, cap: float) -> DataFrame:
    """(lottery, ord, x, capped): winners times prize over the pool before, of draws with winners, and whether the prize stood at the cap."""
    from .order import by, stretched, with_order

    d = stretched(with_order(series).select("lottery", "ord", "pool", "winners1", "prize1"), 1).withColumn("before", F.lag("pool").over(by())).where("not lead and winners1 > 0 and before > 0")
    return d.select("lottery", "ord", F.round(F.col("winners1") * F.col("prize1") / F.col("before"), 9).alias("x"), (F.col("prize1") >= cap).alias("capped"))


def pool_shares(series: DataFrame, cap: float, block: int = 20, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """(lottery, uncapped, capped, mu, sigma, median, mean, lo, hi): the fit of ``paid_shares`` with a block-bootstrap interval of the mean of ln x."""
    from .resampling import block_means

    rows = paid_shares(series, cap).persist()
    fit = censored_lognormal(rows)
    boot = block_means(rows.select("lottery", "ord", F.ln("x").alias("x")), block, replicates, seed)
    return fit.join(boot.select("lottery", "mean", "lo", "hi"), "lottery")
