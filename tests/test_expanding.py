"""Expanding fits over cells of equal features against the fits over draws."""

import numpy as np
from pyspark.sql import functions as F

from drawloom.operators import universe, walkforward
from drawloom.plans import bridge as br


def test_cells_give_the_fits_of_the_draws(spark):
    frame = walkforward.shape_frame(br.draws(spark, "/root/testdata/sf0.01")).where("ord <= 900").persist()
    made, _ = walkforward.expanding_fits(frame, 150, 10)  # 75 cuts: two ranges
    got = {(r.lottery, r.cut): np.array(r.moments) for r in made.collect()}
    fits = walkforward.fit_spans(frame, len(universe.SHAPES), walkforward.expanding_cuts(frame, 150, 10))
    assert len(got) == sum(len(s) for s in fits.spans.values())
    for g, spans in fits.spans.items():
        for span, moments in zip(spans, fits.moments[g], strict=True):
            assert np.allclose(got[g, int(span[1])], moments, rtol=1e-7)
    # what meets the cuts are different features, once a range, and no draw more than once
    cells = walkforward._cells(frame, 150, 10)
    assert cells.where("at > 0").agg(F.sum("y")).first()[0] <= frame.agg(F.sum("winners")).first()[0]
    assert cells.count() < 2 * frame.count()
    frame.unpersist()
