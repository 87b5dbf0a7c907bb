"""Permuted orders of a long series, in parts that no task has to hold whole, with some three bytes a row and replicate shuffled.

A replicate's order is that of the MD5 of seed, replicate and number of a row.
Rows travel as their places in a chunk of the series and their values, packed by
chunk, replicate and part; the part works their digests out again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import md5_numbered

#: Rows of a chunk (their places fit 16 bits), and most chunks' worth of rows that a part has on average.
CHUNK, CHUNKS_A_PART = 65_536, 4


def _chunks(series: DataFrame) -> DataFrame:
    """(lottery, chunk, hole, width, x): the values of ``CHUNK`` rows in order, as integers of ``width`` bytes; ``hole`` stands for null."""

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["ord"].to_numpy(), kind="stable"))).combine_chunks()
        x = rows["x"].combine_chunks()
        known = x.drop_null().to_numpy()
        low, top = int(known.min(initial=0)), int(known.max(initial=0))
        hole = top + 1 if x.null_count else None
        width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and top + 1 < 1 << 8 * w - 1)
        packed = (x.fill_null(hole) if x.null_count else x).to_numpy().astype(f"<i{width}").tobytes()
        return pa.table({"lottery": rows["lottery"][:1], "chunk": rows["chunk"][:1], "hole": pa.array([hole], pa.int64()), "width": pa.array([width], pa.int32()), "x": pa.array([packed], pa.binary())})

    d = series.select("lottery", "ord", F.col("x").cast("bigint").alias("x"), F.expr(f"(ord - 1) div {CHUNK}").alias("chunk"))
    return d.groupBy("lottery", "chunk").applyInArrow(pack, "lottery string, chunk bigint, hole bigint, width int, x binary")


def _texts(seed: int, replicate: int) -> bytes:
    return f"{seed}:{replicate}:".encode()


def _binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``data`` cut into pieces of ``counts`` rows each, as bytes."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def packed_parts(series: DataFrame, B: int, seed: int) -> DataFrame:
    """(lottery, replicate, part, chunk, hole, width, at, x): the rows of every chunk dealt to the parts of every replicate.

    ``series`` has lottery, ord (from 1, without gaps) and whole x.  Replicate 0
    is the series itself, its parts are the chunks; another's parts go by the
    first bits of the digests, as many as keep them to ``CHUNKS_A_PART`` chunks'
    worth of rows.  ``at`` are the rows' places in their chunk.
    """
    chunks = _chunks(series)
    tops = chunks.groupBy("lottery").agg((F.max("chunk") + 1).alias("chunks"))
    each = chunks.join(F.broadcast(tops), "lottery").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(B))))  # one row a game
    spread = each.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lottery", "chunk", "replicate")  # a game's few chunks would be made by as few tasks

    def deal(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["x"], f"<i{r['width']}")
                place = np.arange(len(x))
                bits = min(max(0, int(np.ceil(np.log2(r["chunks"] / CHUNKS_A_PART)))), 16)
                if r["replicate"] == 0:
                    parts, counts = np.array([r["chunk"]]), np.array([len(x)])
                elif bits == 0:
                    parts, counts = np.array([0]), np.array([len(x)])
                else:
                    own = (md5_numbered(_texts(seed, r["replicate"]), r["chunk"] * CHUNK + 1 + place)[0] >> np.uint64(64 - bits)).astype(np.uint16)
                    place = np.argsort(own, kind="stable")
                    x, (parts, counts) = x[place], np.unique(own, return_counts=True)
                same = lambda name, kind: pa.array([r[name]] * len(parts), kind)
                yield pa.RecordBatch.from_arrays(
                    [same("lottery", pa.string()), same("replicate", pa.int32()), pa.array(parts.astype(np.int64)), same("chunk", pa.int64()), same("hole", pa.int64()), same("width", pa.int32()), _binaries(place.astype("<u2"), counts), _binaries(x, counts)],
                    ["lottery", "replicate", "part", "chunk", "hole", "width", "at", "x"],
                )

    return spread.mapInArrow(deal, "lottery string, replicate int, part bigint, chunk bigint, hole bigint, width int, at binary, x binary")


def by_parts(series: DataFrame, B: int, seed: int, measure: Callable[[np.ndarray, np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """(lottery, replicate, part, *schema): the rows that ``measure(x, missing)`` gives of every part of every replicate, in its order; ``missing`` marks the nulls."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(cells: pa.Table) -> pa.Table:
        replicate, ords, values, missing = cells["replicate"][0].as_py(), [], [], []
        for c in cells.to_pylist():
            x = np.frombuffer(c["x"], f"<i{c['width']}").astype(np.int64)
            ords.append(np.frombuffer(c["at"], "<u2").astype(np.int64) + c["chunk"] * CHUNK + 1)
            values.append(x)
            missing.append(x == c["hole"] if c["hole"] is not None else np.zeros(len(x), bool))
        x, gone = np.concatenate(values), np.concatenate(missing)
        if replicate:
            first, last = md5_numbered(_texts(seed, replicate), np.concatenate(ords))
            order = np.argsort(first)
            if (np.diff(first[order]) == 0).any():
                order = np.lexsort((last, first))
            x, gone = x[order], gone[order]
        made = measure(x, gone)
        many = len(made[names[0]])
        key = {n: pa.array([cells[n][0].as_py()] * many, cells.schema.field(n).type) for n in ("lottery", "replicate", "part")}
        return pa.table({**key, **{n: made[n] for n in names}})

    return packed_parts(series, B, seed).groupBy("lottery", "replicate", "part").applyInArrow(run, "lottery string, replicate int, part bigint, " + schema)


def ends_of_runs(x: np.ndarray, missing: np.ndarray) -> dict[str, list]:
    """First and last run of equal x (one row, if there is one run) with the longest of all; a missing x is a run of its own."""
    starts = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | missing[1:] | missing[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(x)))
    ends = sorted({0, len(starts) - 1})
    return {"inner": pa.array([int(sizes.max())] * len(ends)), "run": pa.array([e + 1 for e in ends]), "x": pa.array([None if missing[starts[e]] else int(x[starts[e]]) for e in ends], pa.int64()), "n": pa.array([int(sizes[e]) for e in ends])}


def reach_of_sums(x: np.ndarray, missing: np.ndarray) -> dict[str, list]:
    """The sum of x with the least and greatest partial sum; a missing x adds nothing."""
    sums = np.cumsum(np.where(missing, 0, x))
    return {"sum": pa.array([int(sums[-1])]), "lo": pa.array([int(sums.min())]), "hi": pa.array([int(sums.max())])}
