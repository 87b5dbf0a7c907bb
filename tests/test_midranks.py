"""Ranks of drawn combinations among all: by counted ranges of scores, and worked out once."""

import numpy as np
import pytest

from drawloom.operators import universe, walkforward


@pytest.mark.parametrize("spread", [1.0, 1e-9, 0.0, np.nan])
def test_ranks_by_ranges_equal_ranks_by_sorting(spread):
    rng = np.random.default_rng(5)
    z, c = rng.normal(size=(9, 5000)).round(1), rng.integers(1, 9, 5000).astype(float)
    z[:, 0] = 400.0  # far above all others: most scores lie in few ranges
    for asked in (z[:, rng.integers(0, 5000, 120)], z[:, :3], z[:, 7:8]):
        b = spread * rng.normal(size=9)
        got = walkforward._midranks(z, c, asked, b)
        score = lambda v: np.rint((b[:, None] * v).sum(0) * 1e9).astype(np.int64) if np.isfinite(b).all() else np.zeros(v.shape[1])
        every, s = score(z), score(asked)
        assert got.tolist() == [c[every < x].sum() + c[every <= x].sum() for x in s]


def test_quantiles_are_worked_out_once_for_their_test(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(g, i + 1, (i * 37 % 500) / 500) for g in "ab" for i in range(500)], "lottery string, ord bigint, u double")
    tested = walkforward.quantile_test(rows.mapInArrow(count, rows.schema), 20, 50)
    assert {r.lottery: (r.n, r.mean) for r in tested.collect()} == {"a": (500, 0.499), "b": (500, 0.499)}
    assert seen.value == 1000


def test_blocks_of_cuts_fit_and_rank_their_own_draws(spark):
    rows = [(g, 2001, i + 1, 1000 * j + i, 10**8 + i, i % 7, sorted((i * a + j) % 33 + 1 for a in range(1, 7))) for j, g in enumerate("ab") for i in range(1, 331) if len({(i * a + j) % 33 for a in range(1, 7)}) == 6]
    rows += [("c", 2001, i, 5000 + i, 10**8, 1, [1, 2, 3, 4, 5, 6]) for i in range(1, 101)]  # too few to be ranked
    draws = spark.createDataFrame(rows, "lottery string, issue_year int, issue_seq long, k long, sales long, first_winners long, front array<bigint>")
    made = walkforward.walk_forward_quantiles(draws, 100, 2)  # some hundred cuts: several blocks
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()  # no pass that only makes features
    got = {(r.lottery, r.ord): r.u for r in made.collect()}
    frame = walkforward.shape_frame(draws)
    fits, scale = walkforward.expanding_fits(frame, 100, 2)
    x, c = (np.array(v) for v in zip(*((r.features, r.c) for r in universe.shape_counts(spark, 33, 6).collect()), strict=True))
    beta = {(r.lottery, r.cut): np.array(r.beta)[1:] for r in fits.collect()}
    late = [r for r in frame.collect() if r.ord > 100]
    assert {(r.lottery, r.ord) for r in late} == set(got)
    for r in late[::37]:
        mean, sd = scale[r.lottery]
        b = beta[r.lottery, 101 + (r.ord - 101) // 2 * 2]
        every, mine = (np.rint((((v - mean) / sd) * b).sum(-1) * 1e9) for v in (x, np.array(r.features)))
        assert abs(got[r.lottery, r.ord] - (c[every < mine].sum() + c[every <= mine].sum()) / (2 * c.sum())) < 2e-6
