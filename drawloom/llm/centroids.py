"""Clustering around centroids with bounds loosened by the geometry of each drift.

Every vector keeps a lower bound on its distance to all centroids but its own.
When centroids move, a bound must be loosened.  By how much depends on where the
vectors of a cluster lie: they are within a sphere around the centroid, and seen
in the plane through the sphere's centre and a moving centroid's two positions,
that centroid comes closer to a point of the sphere by no more than its drift
times the cosine of the smallest angle between the drift and the direction of a
point.  A centroid that moves away or sideways loosens nothing or little, where
the plain rule subtracts its whole drift.  A vector whose distance to its own
centroid stays below the bound keeps its cluster; all others are compared with
every centroid in exact integers.

Vectors are packed into blocks, written once and held partitioned by block;
what changes from round to round (cluster, bounds, moved sums) is a small table
of its own, written every round and joined to the blocks where they are.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_stages, integers, stage, staged_so_far, usable

#: Vectors in a block.
BLOCK = 2048
#: Bounds are floating-point numbers: what they must differ by, as a share, to be trusted.
SLACK = 1e-9

STATE = "block long, cluster array<int>, lower array<double>, changed long, scanned long, radius array<double>, moved array<long>, count array<long>"


def squared(x: np.ndarray, centroids: np.ndarray, bound: int) -> np.ndarray:
    """Exact squared distances, vectors by centroids; ``bound`` is on the size of any component.

    Floating-point products are exact while the sums fit in 53 bits; beyond,
    integers of 64 bits are used, which the caller has proved to suffice.
    """
    kind = np.float64 if x.shape[1] * (2 * bound) ** 2 < 2**53 else np.int64
    x, c = x.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return np.stack([((x - one) ** 2).sum(1) for one in c], 1)


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most by which any other centroid can have come closer to a point of its sphere.

    For a move from a to b with midpoint s, a point x is closer by
    2 d t / (|x-a| + |x-b|), with d = |a-b| and t the part of x-s along the
    move.  As |x-a| + |x-b| lies between 2|x-s| and 2|x-s| + d, that is at most
    d cos(angle) for points ahead and d cos(angle) |x-s| / (|x-s| + d/2) for
    points behind.  The least angle over the sphere is the centre's less the
    half-angle under which s sees the sphere.
    """
    k = len(before)
    out = np.zeros(k)
    for i in range(k):
        most = -np.inf
        for j in range(k):
            if j == i:
                continue
            move = after[j] - before[j]
            d = float(np.sqrt((move * move).sum()))
            if not d:
                most = max(most, 0.0)
                continue
            way = before[i] - (before[j] + after[j]) / 2
            far = float(np.sqrt((way * way).sum()))
            if radius[i] >= far:
                most = max(most, d)
                continue
            angle = np.arccos(np.clip(float(way @ move) / (far * d), -1, 1)) - np.arcsin(radius[i] / far)
            closer = d * np.cos(max(angle, 0.0))
            if closer < 0:
                near = far - radius[i]
                closer *= near / (near + d / 2)
            most = max(most, closer)
        out[i] = most if np.isfinite(most) else 0.0
    return out


def reassigned(x: np.ndarray, cluster: np.ndarray, lower: np.ndarray, centroids: np.ndarray, loosen: np.ndarray, bound: int):
    """New clusters, lower bounds, exact squared distances to the own centroid, and which vectors were compared with all centroids."""
    own = squared_to(x, centroids[cluster], bound)
    lower = lower - loosen[cluster] - SLACK * (1 + np.abs(lower) + np.abs(loosen[cluster]))
    open_ = ~(np.sqrt(own.astype(np.float64)) * (1 + SLACK) < lower)
    if open_.any():
        every = squared(x[open_], centroids, bound)
        best = every.argmin(1)  # ties: the smaller number
        rows = np.arange(len(best))
        cluster, lower, own = cluster.copy(), lower.copy(), own.copy()
        cluster[open_], own[open_] = best, every[rows, best]
        if len(centroids) > 1:
            others = every.astype(np.float64)
            others[rows, best] = np.inf
            lower[open_] = np.sqrt(others.min(1)) * (1 - SLACK)
        else:
            lower[open_] = np.inf
    return cluster, lower, own, open_


def squared_to(x: np.ndarray, own: np.ndarray, bound: int) -> np.ndarray:
    """Exact squared distance of each row of ``x`` to the same row of ``own``."""
    away = x - own
    return (away * away).sum(1)


def _packed(batches):
    """Blocks of up to BLOCK vectors: a number of their own, the ids and all components in one list."""
    from pyspark import TaskContext

    at, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.slice(start, BLOCK)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays([pa.array([(at << 33) + done]), one(part.column(0)), one(part.column(1).flatten())], ["block", "ids", "values"])
            done += 1


def _first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in kept.select(order.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(rows, centroids): each kept vector's id, cluster and squared distance; each centroid's number, components, size and inertia.

    Components become floor(scale * x).  The centroids start as the ``k``
    vectors that come first by sha256 of ``seed:id`` (null ids last, then by
    components).  Each of ``rounds`` rounds assigns every vector to the nearest
    centroid (ties: the smaller number) and moves every centroid that has
    vectors to the floor of their mean; then vectors are assigned once more.

    Vectors of another length, null ones and those with a null or non-finite
    component are left out; rows with null or repeated ids come back each.
    With fewer vectors than ``k`` there are as many centroids as vectors; with
    none there are no rows.  Components so large that squared distances might
    not fit in 64 bits raise an error.
    """
    spark, begun = vectors.sparkSession, staged_so_far()
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    kept = vectors.where(usable(v) & (F.size(v) == dimensions)).select(F.col(id_col).alias("id"), integers(v, scale).alias("v"))
    blocks = stage(kept.mapInArrow(_packed, f"block long, ids array<{kind}>, values array<long>"))
    facts = blocks.agg(F.max(F.array_max(F.transform("values", F.abs))).alias("top"), F.sum(F.size("ids")).alias("n")).first()
    n, bound = facts.n or 0, (facts.top or 0) + 1
    row_fields = f"{id_col} {kind}, cluster int, distance long"
    if not n:
        return spark.createDataFrame([], row_fields), spark.createDataFrame([], "cluster int, components array<long>, size long, inertia decimal(38,0)")
    if dimensions * (2 * bound) ** 2 >= 2**63 or n * bound >= 2**63:
        raise ValueError("components too large for exact distances in 64 bits")
    centroids = np.array(_first_centroids(kept, k, seed), np.int64)
    k = len(centroids)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = blocks.repartition(parts, "block").persist(StorageLevel.DISK_ONLY)

    def step(centroids: np.ndarray, loosen: np.ndarray, first: bool):
        def run(batches):
            for batch in batches:
                at = {name: i for i, name in enumerate(batch.schema.names)}
                for r in range(len(batch)):
                    x = batch.column(at["values"])[r].values.to_numpy().reshape(-1, dimensions)
                    if first:
                        was, lower = np.full(len(x), -1), np.full(len(x), -np.inf)
                    else:
                        was, lower = (batch.column(at[c])[r].values.to_numpy() for c in ("cluster", "lower"))
                    cluster, lower, own, scanned = reassigned(x, np.maximum(was, 0), lower, centroids, loosen, bound)
                    far = np.zeros(k)
                    np.maximum.at(far, cluster, np.sqrt(own.astype(np.float64)) * (1 + SLACK))
                    change = np.flatnonzero(cluster != was)
                    moved, count = np.zeros((k, dimensions), np.int64), np.bincount(cluster[change], minlength=k)
                    np.add.at(moved, cluster[change], x[change])
                    if not first:
                        np.subtract.at(moved, was[change], x[change])
                        count = count - np.bincount(was[change], minlength=k)
                    one = lambda a, t: pa.array([a], pa.list_(t))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(at["block"])[r].as_py()]), one(cluster.astype(np.int32), pa.int32()), one(lower, pa.float64()), pa.array([len(change)]), pa.array([int(scanned.sum())]),
                         one(far, pa.float64()), one(moved.ravel(), pa.int64()), one(count.astype(np.int64), pa.int64())],
                        ["block", "cluster", "lower", "changed", "scanned", "radius", "moved", "count"],
                    )

        return run

    def met(state: DataFrame) -> DataFrame:
        """The blocks with what the last round has left of them; only the small side is shuffled."""
        return home.join(state.select("block", "cluster", "lower").hint("shuffle_hash"), "block")

    state, loosen = None, np.zeros(k)
    sums, counts = [0] * (k * dimensions), [0] * k
    for number in range(rounds + 1):
        state = stage((home if state is None else met(state)).mapInArrow(step(centroids, loosen, state is None), STATE))
        if number == rounds:
            break
        # k * dimensions sums, k counts and k radii reach the driver
        none, nil = F.lit(None).cast("long"), F.lit(None).cast("double")
        exact = [state.select(F.lit(c).alias("what"), F.posexplode(c).alias("at", "x"), nil.alias("far")) for c in ("moved", "count")]
        far = state.select(F.lit("radius").alias("what"), F.posexplode("radius").alias("at", "far")).select("what", "at", none.alias("x"), "far")
        radius = np.zeros(k)
        for r in exact[0].unionByName(exact[1]).unionByName(far).groupBy("what", "at").agg(F.sum("x").alias("x"), F.max("far").alias("far")).collect():
            if r.what == "moved":
                sums[r.at] += r.x
            elif r.what == "count":
                counts[r.at] += r.x
            else:
                radius[r.at] = r.far
        after = centroids.copy()
        for i in range(k):
            if counts[i]:
                after[i] = [s // counts[i] for s in sums[i * dimensions : (i + 1) * dimensions]]
        if (after == centroids).all():
            break  # every further round would repeat this one
        loosen = loosening(centroids.astype(np.float64), after.astype(np.float64), radius)
        centroids = after

    def unpacked(batches):
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for r in range(len(batch)):
                x = batch.column(at["values"])[r].values.to_numpy().reshape(-1, dimensions)
                cluster = batch.column(at["cluster"])[r].values
                own = squared_to(x, centroids[cluster.to_numpy()], bound)
                yield pa.RecordBatch.from_arrays([batch.column(at["ids"])[r].values, cluster, pa.array(own.astype(np.int64))], [id_col, "cluster", "distance"])

    rows = stage(met(state).mapInArrow(unpacked, row_fields))
    home.unpersist()
    clear_stages(spark, begun, 1)
    inertia = {r.cluster: r for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    table = [(i, c.tolist(), inertia[i].size if i in inertia else 0, inertia[i].inertia if i in inertia else Decimal(0)) for i, c in enumerate(centroids)]
    return rows, spark.createDataFrame(table, "cluster int, components array<long>, size long, inertia decimal(38,0)")
