"""Ranks and windows over a game's draws that do not put a game into one task.

A game's draws are numbered by counting: first per part (parts follow each
other in order), then by a row number within the part.  Windows run over
stretches of draws; each stretch takes along the last draws of the one before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Issue numbers in a part; draws in a stretch.
PART = 2048
STRETCH = 2048


def by() -> WindowSpec:
    """Window over a stretch in order."""
    return Window.partitionBy("lottery", "stretch").orderBy("ord")


def rank_by_parts(df: DataFrame, group: list[str], part: Column, order: list, name: str) -> DataFrame:
    """``df`` with the row number ``name`` (from 1) within ``group``; ``part`` must not fall along ``order``."""
    d = df.withColumn("_part", part)
    counts = d.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = counts.select(*group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return d.join(before, [*group, "_part"]).withColumn(name, (within + F.col("_before")).cast("bigint")).drop("_part", "_before")


def with_order(draws: DataFrame) -> DataFrame:
    """Number the draws of a game from 1 in issue order."""
    part = F.col("issue_year").cast("bigint") * 1_000_000 + F.expr(f"issue_seq div {PART}")
    return rank_by_parts(draws, ["lottery"], part, ["issue_year", "issue_seq"], "ord")


def stretched(ordered: DataFrame, lead: int = 0) -> DataFrame:
    """Rows with their ``stretch``; the last ``lead`` of each stretch are there again as ``lead`` rows of the next."""
    own = F.expr(f"(ord - 1) div {STRETCH}")
    if not lead:
        return ordered.withColumn("stretch", own).withColumn("lead", F.lit(False))
    reach = F.expr(f"(ord - 1 + {lead}) div {STRETCH}")
    d = ordered.withColumn("stretch", F.explode(F.sequence(own, reach)))
    return d.withColumn("lead", F.col("stretch") > own)


def by_stretches(d: DataFrame, work: Callable[[pa.Table], dict[str, pa.Array]], schema: StructType | str) -> DataFrame:
    """``work`` on the rows of every stretch in order of ``ord``, as one Arrow table of some thousand rows, with the columns it gives."""
    names = schema.fieldNames() if isinstance(schema, StructType) else [c.split()[0] for c in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        out = work(table.take(pa.array(np.argsort(table["ord"].to_numpy(), kind="stable"))).combine_chunks())
        return pa.table({n: out[n] for n in names})

    return d.groupBy("lottery", "stretch").applyInArrow(run, schema)


def cells(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value (int64) of all entries of a column of arrays that are not null."""
    flat = lists.combine_chunks()
    sizes = np.asarray(flat.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = flat.flatten()
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return rows[there], places[there], values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def upto(seen: np.ndarray) -> np.ndarray:
    """Running sums along the rows; entry i holds those of the first i rows."""
    return np.concatenate([np.zeros((1, *seen.shape[1:]), np.int64), np.cumsum(seen, axis=0, dtype=np.int64)])


def carried(ordered: DataFrame, values: list[str]) -> DataFrame:
    """(lottery, stretch, *values): the greatest of each value in all stretches before; null in the first."""
    per = ordered.groupBy("lottery", F.expr(f"(ord - 1) div {STRETCH}").alias("stretch")).agg(*(F.max(v).alias(v) for v in values))
    earlier = Window.partitionBy("lottery").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    return per.select("lottery", "stretch", *(F.max(v).over(earlier).alias(v) for v in values))


def summed(ordered: DataFrame, values: list[str]) -> DataFrame:
    """(lottery, stretch, *values): the sums of each value over all stretches before."""
    per = ordered.groupBy("lottery", F.expr(f"(ord - 1) div {STRETCH}").alias("stretch")).agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy("lottery").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    return per.select("lottery", "stretch", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values))


def quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(*group, *wanted): exact interpolated quantiles by ranks over value ranges, not by a hash of all values of a group.

    Values are counted per distinct value; those at the ranks asked for follow
    from running counts over ranges of values and within the ranges that hold them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    bounds = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    cut = F.floor((F.col("_v") - F.col("_lo")) * 512.0 / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300)))
    d = counts.join(bounds, group).withColumn("_range", cut)
    per = d.groupBy(*group, "_range").agg(F.sum("_c").alias("_in"))
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    per = per.select(*group, "_range", F.sum("_in").over(upto).alias("_upto"), "_in")
    at = {name: (F.col("_n") - 1) * q for name, q in wanted.items()}
    holds = F.lit(False)
    for x in at.values():
        holds = holds | ((F.col("_upto") > F.floor(x)) & (F.col("_upto") - F.col("_in") <= F.ceil(x)))
    inside = Window.partitionBy(*group, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(per, [*group, "_range"]).where(holds).withColumn("_run", F.sum("_c").over(inside) + F.col("_upto") - F.col("_in"))
    value_at = lambda rank: F.min(F.when(F.col("_run") > rank, F.col("_v")))
    ends = [c for name, x in at.items() for c in (value_at(F.floor(x)).alias(f"_a_{name}"), value_at(F.ceil(x)).alias(f"_b_{name}"), F.max(x - F.floor(x)).alias(f"_f_{name}"))]
    g = d.groupBy(*group).agg(*ends)
    return g.select(*group, *((F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).cast("double").alias(n) for n in wanted))


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(*group, middle): exact medians by ``quantiles``."""
    return quantiles(df, group, value, {"middle": 0.5})
