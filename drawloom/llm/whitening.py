"""Whitening of embeddings by a covariance weighted with multiplicities.

Equal integer vectors are grouped first, so every distinct vector is centred,
multiplied and projected once, whatever its copies; the copies are its weight
in the fit (or one, if distinct vectors are to count alike).  Sums are exact
integers.  The covariance is added up from blocks of centred vectors by matrix
products in the tasks; only its d * d entries reach the driver.  The projected
vectors are joined back to all rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense, integers, join_hot, stage, usable

#: An eigenvalue counts as none if it is below this share of the largest, times the dimensions: rounding leaves so much.
NO_VARIANCE = 1e-15
#: Digits of Spark's widest decimal.
WIDEST = 10**38


def _deviations(x: np.ndarray, n: int, sums: list[int], bound: int) -> np.ndarray:
    """n * x - sums without rounding: 64-bit integers where they provably hold it, else Python's."""
    kind = np.int64 if 2 * n * bound < 2**63 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _squares(deviations: np.ndarray) -> list[Decimal | None]:
    """The exact sum of squares of each row; none beyond 38 digits."""
    rows, width = deviations.shape
    top = int(np.abs(deviations).max(initial=0))
    if width * top * top >= 2**63:
        deviations = deviations.astype(object)
    return [Decimal(s) if s < WIDEST else None for s in map(int, (deviations * deviations).sum(1))]


def _added(parts: DataFrame, kind: str) -> dict:
    """Parts summed by place; as many rows as there are places come to the driver."""
    return {r.place: r.part for r in parts.groupBy("place").agg(F.sum("part").cast(kind).alias("part")).collect()}


def _products(rows: DataFrame, width: int, block) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums and sums of products of the columns that ``block`` makes of a batch, with their weights."""
    upper = np.triu_indices(width)

    def run(batches):
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            y, w = block(batch)
            total += w @ y
            products += (y * w[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + len(upper[0]), dtype=np.int32)), pa.array(np.concatenate([total, products[upper]]))], ["place", "part"])

    got = _added(rows.mapInArrow(run, "place int, part double"), "double")
    flat = np.array([got[i] for i in range(width + len(upper[0]))])
    full = np.zeros((width, width))
    full[upper] = flat[width:]
    return flat[:width], full + np.triu(full, 1).T


def whitened(
    vectors: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, weight: str = "copies", id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Each usable row's id with its whitened vector and what the fit says of it.

    Columns: id, n (weight of the fit list), deviation (sum over dimensions of
    (n * x - S)^2 as decimal(38, 0), null beyond 38 digits), whitened and
    explained (arrays, one entry a component, by falling eigenvalue),
    identity_error (largest entry of the whitened vectors' covariance less the
    identity).  x is floor(scale * component) + offset.

    ``weight`` is ``copies`` (every row counts in the fit) or ``distinct``
    (every distinct vector once).  Rows whose vector is null or holds a null or
    non-finite component are left out; rows with a null id or a repeated id
    come back each.  Missing trailing components count as 0.  A component
    without variance (fewer independent vectors than components, equal vectors
    only) has null for its whitened value and explains 0; identity_error is
    over the others, and 0 without any.  Components that no 64-bit integer
    holds raise an error.  No usable rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("_id"), integers(F.col(vector_col), scale, offset).alias("x"))
    distinct = stage(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")))
    weigh = F.col("copies") if weight == "copies" else F.lit(1).cast("long")
    fit = distinct.select("x", weigh.alias("w"))
    facts = fit.agg(F.sum("w").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("top")).first()
    n, width, bound = facts.n or 0, facts.width or 0, max(facts.top or 0, abs(offset))
    out = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not n:
        return spark.createDataFrame([], out)

    def sums_of(batches):
        kind = np.int64 if n * bound < 2**63 else object
        for batch in batches:
            x, w = dense(batch.column(0), width, offset).astype(kind), batch.column(1).to_numpy().astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([Decimal(int(s)) for s in w @ x], pa.decimal128(38))], ["place", "part"])

    sums = _added(fit.mapInArrow(sums_of, "place int, part decimal(38,0)"), "decimal(38,0)")
    sums = [int(sums[i]) for i in range(width)]

    def centred(batch):
        away = _deviations(dense(batch.column(0), width, offset), n, sums, bound)
        return away.astype(np.float64) / n, batch.column(1).to_numpy().astype(np.float64)

    _, products = _products(fit, width, centred)
    values, axes = np.linalg.eigh(products / n) if width else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    values, axes, trace = values[order], axes[:, order], float(np.trace(products) / n)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0) if len(order) else axes
    varied = values > NO_VARIANCE * width * values.max(initial=0.0)
    project = axes[:, varied] / np.sqrt(values[varied])
    explained = [float(v / trace) if ok else 0.0 for v, ok in zip(values, varied, strict=True)]
    place = np.where(varied, np.cumsum(varied) - 1, -1)

    def projected(batches):
        for batch in batches:
            away = _deviations(dense(batch.column(0), width, offset), n, sums, bound)
            y = away.astype(np.float64) / n @ project
            spread = np.concatenate([y, np.zeros((len(y), 1))], 1)[:, place]  # a component without variance takes the last column
            none = np.broadcast_to(~varied, spread.shape).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(place)), pa.array(spread.ravel(), mask=none))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(_squares(away), pa.decimal128(38))], ["x", "copies", "whitened", "deviation"])

    each = stage(distinct.mapInArrow(projected, "x array<long>, copies long, whitened array<double>, deviation decimal(38,0)"))
    kept = int(varied.sum())
    error = 0.0
    if kept:

        def again(batch):
            flat = batch.column(0).flatten().drop_null().to_numpy(zero_copy_only=False)
            return flat.reshape(-1, kept), batch.column(1).to_numpy().astype(np.float64)

        total, products = _products(each.select("whitened", weigh.alias("w")), kept, again)
        error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(kept)).max())

    joined = join_hot(rows, each, ["x"], "copies", n, least=100)
    return joined.select(F.col("_id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
