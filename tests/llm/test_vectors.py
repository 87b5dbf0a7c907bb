"""Whitening and clustering against plain versions in numpy and Python integers, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawloom.llm import centroids, queries, topk, whitening

VECTORS = "vec_id long, embedding array<float>, x int, copies long, block long, cluster int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], VECTORS)


def _rows(n=120, d=6, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 3
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(n // 2)]  # a third of all rows are copies of one
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * d), (2003, [float("inf")] * d), (3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    return rows + odd


def _usable(rows):
    return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("weight", ["copies", "distinct"])
def test_whitening_equals_numpy(spark, weight):
    rows = _rows()
    good = _usable(rows)
    got = whitening.whitened(_frame(spark, rows), components=4, weight=weight).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in good)
    x = [tuple(math.floor(64 * v) + 1_000_000 for v in vec) for _, vec in good]
    fit = np.array(x if weight == "copies" else sorted(set(x)), object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array(n * fit - sums, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = {}
    for (i, _), row in zip(good, x, strict=True):
        away = n * np.array(row, object) - sums
        want.setdefault(i, []).append((int((away * away).sum()), (np.array(away, float) / n) @ axes[:, :4] / np.sqrt(values[:4])))
    signs = np.sign(sum(np.array(r.whitened) * min(want[r.vec_id], key=lambda w: abs(w[0] - int(r.deviation)))[1] for r in got))
    for r in got:
        near = [w for w in want[r.vec_id] if w[0] == int(r.deviation)]
        assert near and min(np.abs(np.array(r.whitened) * signs - w[1]).max() for w in near) < 1e-9
        assert r.n == n and r.identity_error < 1e-9 and np.allclose(r.explained, values[:4] / values.sum(), rtol=1e-9)


def test_whitening_of_short_equal_few_and_no_vectors(spark):
    assert whitening.whitened(_frame(spark, [])).count() == 0 and whitening.whitened(_frame(spark, [(1, None), (2, [None])])).count() == 0
    short = whitening.whitened(_frame(spark, [(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [0.0, 0.0])]), components=2).collect()
    by = {r.vec_id: r for r in short}
    assert len(short) == 4 and by[3].whitened == by[4].whitened and all(w is not None for w in by[2].whitened)
    equal = whitening.whitened(_frame(spark, [(i, [0.5, 0.5]) for i in range(5)])).collect()
    assert len(equal) == 5 and {tuple(r.whitened) for r in equal} == {(None, None)} and {r.identity_error for r in equal} == {0.0} and {r.deviation for r in equal} == {0}
    few = whitening.whitened(_frame(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])])).first()
    assert [w is None for w in few.whitened] == [False, False, True] and few.explained[2] == 0.0
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(_frame(spark, [(1, [1e30])])).count()


def test_deviations_are_exact_beyond_64_bits():
    x, n = np.array([[10**15, -(10**15)], [1, 2]]), 10**7
    away = whitening._deviations(x, n, [5, 7], 10**15)
    assert away.tolist() == [[10**22 - 5, -(10**22) - 7], [10**7 - 5, 2 * 10**7 - 7]]
    big, small = whitening._squares(away)
    assert big is None and int(small) == (10**7 - 5) ** 2 + (2 * 10**7 - 7) ** 2
    assert int(whitening._squares(np.array([[2**40, 3]]))[0]) == 2**80 + 9


def _lloyd(rows, k, rounds, d, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in _usable(rows) if len(v) == d]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = [min((far(v, one), j) for j, one in enumerate(c)) for _, v in kept]
        if step < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, a) in zip(kept, near, strict=True) if a == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted((i is None, i or 0, a, dist) for (i, _), (dist, a) in zip(kept, near, strict=True)), c


@pytest.mark.parametrize("rounds,k", [(0, 3), (1, 4), (6, 5), (25, 8), (3, 1)])
def test_clusters_equal_plain_rounds(spark, rounds, k):
    rng = random.Random(k)
    rows = _rows(seed=k) + [(5000 + i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(80)] + [(6000, [1.0] * 5), (6001, [])]
    got, found = centroids.clustered(_frame(spark, rows).repartition(3), k=k, rounds=rounds, dimensions=6)
    want, c = _lloyd(rows, k, rounds, 6)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got.collect()) == want
    table = {r.cluster: r for r in found.collect()}
    assert [list(table[j].components) for j in range(k)] == c
    for j in range(k):
        own = [w[3] for w in want if w[2] == j]
        assert (table[j].size, table[j].inertia) == (len(own), sum(own))


def test_fewer_vectors_than_centroids_equal_vectors_and_none(spark):
    rows, found = centroids.clustered(_frame(spark, [(1, [1.0, 1.0]), (2, [1.0, 1.0])]), k=8, dimensions=2)
    assert {(r.vec_id, r.cluster, r.distance) for r in rows.collect()} == {(1, 0, 0), (2, 0, 0)} and found.count() == 2
    rows, found = centroids.clustered(_frame(spark, [(1, None), (2, [1.0])]), dimensions=2)
    assert rows.count() == found.count() == 0
    with pytest.raises(ValueError):
        centroids.clustered(_frame(spark, [(1, [1e12, 0.0])]), dimensions=2)


def test_loosening_is_a_bound_and_less_than_the_drift():
    rng = np.random.default_rng(3)
    less = total = 0
    for _ in range(200):
        k, d = 5, 4
        before = rng.normal(size=(k, d)) * 5
        after = before + rng.normal(size=(k, d)) * rng.choice([0.0, 0.1, 1.0, 5.0], size=(k, 1))
        radius = rng.uniform(0, 4, k)
        bound = centroids.loosening(before, after, radius)
        for i in range(k):
            way = rng.normal(size=(300, d))
            x = before[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            others = [j for j in range(k) if j != i]
            closer = np.stack([np.linalg.norm(x - before[j], axis=1) - np.linalg.norm(x - after[j], axis=1) for j in others], 1)
            assert closer.max() <= bound[i] + 1e-9
            drift = max(np.linalg.norm(after[j] - before[j]) for j in others)
            assert bound[i] <= drift + 1e-9
            less += bound[i] < 0.9 * drift
            total += 1
    assert less > total / 3


def test_bounds_spare_comparisons():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(500, 8)) * 40 + rng.normal(size=8) * 1500 for _ in range(6)]).astype(np.int64)
    c = x[::500].copy()
    cluster, lower, _, scanned = centroids.reassigned(x, np.zeros(len(x), np.int64), np.full(len(x), -np.inf), c, np.zeros(6), 10**5)
    assert scanned.all()
    for _ in range(3):
        radius = np.array([np.sqrt(((x[cluster == i] - c[i]) ** 2).sum(1).max(initial=0)) for i in range(6)])
        after = np.array([x[cluster == i].sum(0) // max((cluster == i).sum(), 1) for i in range(6)])
        loosen = centroids.loosening(c.astype(float), after.astype(float), radius)
        c = after
        cluster, lower, own, scanned = centroids.reassigned(x, cluster, lower, c, loosen, 10**5)
        every = ((x[:, None, :] - c[None]) ** 2).sum(2)
        assert (cluster == every.argmin(1)).all() and (own == every.min(1)).all()
        assert scanned.mean() < 0.2


def test_exact_distances_beyond_53_bits():
    x, c = np.array([[2**28 + 1, 5], [3, 4]]), np.array([[0, 1], [2**28, 0]])
    assert centroids.squared(x, c, 2**28 + 2).tolist() == [[(2**28 + 1) ** 2 + 16, 26], [18, (2**28 - 3) ** 2 + 16]]


def test_queries_give_the_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    made = queries.op11_whitening(spark, sf)
    assert made.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and made.schema["deviation"].dataType.simpleString() == "bigint"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert made.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).count() == 32


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        topk.exact_topk(_frame(spark, [(100, [1e18, 1.0]), (1, [1e18, 2.0])]))
    assert topk.exact_topk(_frame(spark, [(100, [1e5, 1.0]), (1, [1e5, 2.0])])).first().score == (1024 * 10**5) ** 2 + 1024 * 2048
