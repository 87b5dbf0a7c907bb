"""Tickets of a batch that overlap little, chosen by score without putting a batch into one task."""

from __future__ import annotations

import tempfile
import uuid
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import number_mask
from .order import medians

#: Parts into which a batch is dealt before its best tickets are ranked.
PARTS = 64
#: Batches of at most so many rows are settled as one row each; larger ones in rounds over all tasks.
SMALL = 1024


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back, which cuts its lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="drawloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/drawloom-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _shared_subsets(numbers: Column, most: int, size: int) -> Column:
    """The subsets of ``size`` of a ticket's up to ``most`` numbers, as masks; none if it has fewer."""
    subsets = [F.when(F.size(numbers) > s[-1], number_mask(F.array(*(F.get(numbers, F.lit(i)) for i in s)))) for s in combinations(range(most), size)]
    return F.filter(F.array(*subsets), lambda x: x.isNotNull())


def independent(tickets: DataFrame, cap: int, most: int = 6) -> DataFrame:
    """(batch, o): the tickets that a greedy choice in the order ``o`` takes, each with at most ``cap`` numbers in common with any taken before.

    ``tickets`` has (batch, o, numbers): different sets of up to ``most``
    numbers below 64 in a batch, and places ``o`` that differ.  Two tickets
    conflict if they share a subset of ``cap`` + 1 numbers.  In each round
    those are taken that come first under every one of their subsets, and all
    others under these subsets go, so a subset costs an aggregate and no pairs
    are made.  Every round settles at least the first ticket left of each
    batch; the result equals the choice one by one.
    """
    rows = tickets.select("batch", "o", F.explode(_shared_subsets(F.col("numbers"), most, cap + 1)).alias("key"))
    under = rows.groupBy("batch", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    live = written(rows.join(under, ["batch", "key"]))  # what only one ticket has bars none
    taken = written(tickets.select("batch", "o").join(live.select("batch", "o").distinct(), ["batch", "o"], "left_anti"))
    while not live.isEmpty():
        first = live.groupBy("batch", "key").agg(F.min("o").alias("first"))
        leads = live.join(first, ["batch", "key"]).groupBy("batch", "o").agg(F.every(F.col("o") == F.col("first")).alias("all")).where("all").select("batch", "o")
        leads = written(leads)
        barred = first.withColumnRenamed("first", "o").join(leads, ["batch", "o"]).select("batch", "key")
        gone = live.join(barred, ["batch", "key"]).select("batch", "o").distinct()
        live = written(live.join(gone, ["batch", "o"], "left_anti"))
        taken = taken.unionByName(leads)
    return taken


def compress(tickets: DataFrame, cap: int, target: Column | None = None, quality: float = 0.8, ratio: float = 0.5, least: int = 3, most: int = 6) -> DataFrame:
    """(batch, ticket_id, kept, reason): a batch cut down to ``target`` tickets, best score first, of equals the smaller id.

    Tickets under ``quality`` times the batch's median score are left out, then
    repeated numbers, then tickets with more than ``cap`` numbers in common with
    one taken; at the target the choice ends.  Where fewer are found than the
    target (without one: than ``least``, the target then being ``ratio`` of the
    batch, at least ``least``), the best others with numbers of their own fill
    up.  Batches of at most ``least`` tickets, or of no more than the target,
    stay whole.  A null score is 0.  Rows with equal id, numbers and score are one
    ticket and give one row; of equal scores and ids the smaller numbers come first.

    ``reason`` is whole, fits, filled, quality, duplicate, overlap or target.
    Batches of up to SMALL rows are gathered and settled in one shuffle.
    """
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    wanted = F.lit(None).cast("bigint") if target is None else F.greatest(F.lit(1), target).cast("bigint")
    t = tickets.select("batch", "ticket_id", score.alias("score"), F.array_sort(F.array_distinct("main")).alias("numbers"), wanted.alias("wanted"))
    clean = F.col("numbers").isNotNull() & F.forall("numbers", lambda x: x.isNotNull())
    sized = t.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.every(F.coalesce(clean, F.lit(False))).alias("clean")).where("batch is not null")
    sized = written(sized.select("batch", (F.col("clean") & (F.col("rows") <= SMALL)).alias("small")))
    small = _compress_small(t.join(sized.where("small").select("batch"), "batch"), cap, quality, ratio, least, most)
    large = sized.where("not small").select("batch")
    return small if large.isEmpty() else small.unionByName(_compress_large(t.join(large, "batch"), cap, quality, ratio, least, most))


#: Reasons by their codes.
REASONS = ("fits", "filled", "quality", "target", "duplicate", "overlap")


def _reasons(score: np.ndarray, numbers: np.ndarray, mask: np.ndarray, line: float, goal: int, fill: int, cap: int) -> np.ndarray:
    """The codes of a batch's tickets in order: ``numbers`` are equal for equal numbers, ``mask`` are those that may be in common."""
    at = np.arange(len(score))
    _, lead, of = np.unique(numbers, return_index=True, return_inverse=True)
    lead = lead[of]
    left, taken = at[(lead == at) & (score >= line)], []
    while len(left) and len(taken) < goal:
        taken.append(left[0])
        left = left[1:][np.bitwise_count(mask[left[1:]] & mask[left[0]]) <= cap]
    fits = np.zeros(len(score), bool)
    fits[taken] = True
    filled = np.zeros(len(score), bool)
    filled[at[(lead == at) & ~fits][: max(0, fill - len(taken))]] = True
    over = (at > taken[-1]) if taken and len(taken) >= goal else np.zeros(len(score), bool)
    return np.select([fits, filled, score < line, over, fits[lead]], range(5), 5)


def _compress_small(t: DataFrame, cap: int, quality: float, ratio: float, least: int, most: int) -> DataFrame:
    """``compress`` of batches that are gathered as one row each."""
    row = F.struct((F.lit(0.0) - F.col("score")).alias("back"), "ticket_id", "numbers", number_mask(F.col("numbers")).alias("all"), number_mask(F.slice("numbers", 1, most)).alias("mask"))
    d = t.groupBy("batch").agg(F.array_distinct(F.array_sort(F.collect_list(row))).alias("t"), F.max("wanted").alias("wanted")).withColumn("n", F.size("t"))
    lower, upper = (-F.element_at("t", (F.col("n") - x).cast("int"))["back"] for x in (F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    middle = lower + (upper - lower) * ((F.col("n") - 1) % 2 / 2)
    goal = F.coalesce("wanted", F.greatest(F.lit(least), F.ceil(F.col("n") * ratio)).cast("bigint"))
    whole = (F.col("n") <= max(1, least)) | (F.coalesce("wanted", F.lit(0)) >= F.col("n"))
    d = d.select("batch", "t", whole.alias("whole"), F.round(middle * quality, 9).alias("line"), goal.alias("goal"), F.coalesce("wanted", F.lit(least)).cast("bigint").alias("fill"))

    def run(batches):
        for b in batches:
            rows = b.column("t")
            flat, ends = rows.flatten(), np.cumsum(pc.list_value_length(rows).to_numpy())
            back, every, mask = (flat.field(x).to_numpy() for x in ("back", "all", "mask"))
            whole, line, goal, fill = (b.column(x).to_numpy(zero_copy_only=False) for x in ("whole", "line", "goal", "fill"))
            codes = np.full(len(flat), -1)
            for i, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if not whole[i]:
                    codes[lo:hi] = _reasons(-back[lo:hi], every[lo:hi], mask[lo:hi], line[i], goal[i], fill[i], cap)
            reason = pa.array(["whole", *REASONS]).take(pa.array(codes + 1))
            parents = pc.list_parent_indices(rows)
            yield pa.RecordBatch.from_arrays([b.column("batch").take(parents), flat.field("ticket_id"), pa.array(codes < 2), reason], ["batch", "ticket_id", "kept", "reason"])

    kinds = dict(t.dtypes)
    return d.mapInArrow(run, f"batch {kinds['batch']}, ticket_id {kinds['ticket_id']}, kept boolean, reason string")


def _compress_large(t: DataFrame, cap: int, quality: float, ratio: float, least: int, most: int) -> DataFrame:
    """``compress`` in rounds, no batch in one task."""
    t = written(t.distinct().withColumn("o", F.struct((-F.col("score")).alias("back"), "ticket_id", "numbers")))
    sizes = t.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("wanted").alias("wanted")).join(medians(t, ["batch"], "score"), "batch")
    goal = F.coalesce("wanted", F.greatest(F.lit(least), F.ceil(F.col("n") * ratio)).cast("bigint"))
    whole = (F.col("n") <= max(1, least)) | (F.coalesce("wanted", F.lit(0)) >= F.col("n"))
    sizes = written(sizes.select("batch", whole.alias("whole"), goal.alias("goal"), F.coalesce("wanted", F.lit(least)).cast("bigint").alias("fill"), F.round(F.col("middle") * quality, 9).alias("line")))
    d = t.join(sizes, "batch")
    # of equal numbers the first by score stands for all
    firsts = d.where("not whole").groupBy("batch", "numbers").agg(F.min("o").alias("o"), F.first("line").alias("line"))
    firsts = written(firsts)
    chosen = independent(firsts.where(-F.col("o.back") >= F.col("line")).select("batch", "o", "numbers"), cap, most)
    # at the target the choice ends: at most ``goal`` of each part can count
    ranked = _leading(chosen.join(sizes.select("batch", "goal", "fill"), "batch"), F.col("goal"))
    ranked = written(ranked)
    end = ranked.groupBy("batch").agg(F.count(F.lit(1)).alias("found"), F.max("o").alias("end"))
    state = sizes.join(end, "batch", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    lacking = state.where("not whole and found < fill").select("batch", (F.col("fill") - F.col("found")).alias("lack"))
    spare = firsts.join(ranked.select("batch", "o"), ["batch", "o"], "left_anti").join(lacking, "batch")
    filled = _leading(spare.select("batch", "o", "lack"), F.col("lack")).select("batch", "o", F.lit(True).alias("filled"))
    fits = firsts.select("batch", "numbers", F.col("o").alias("lead")).join(ranked.select("batch", F.col("o").alias("lead")), ["batch", "lead"])
    out = t.join(state, "batch").join(fits, ["batch", "numbers"], "left").join(filled, ["batch", "o"], "left")
    reason = (
        F.when(F.col("whole"), "whole").when(F.col("o") == F.col("lead"), "fits").when(F.col("filled"), "filled").when(F.col("score") < F.col("line"), "quality")
        .when((F.col("found") >= F.col("goal")) & (F.col("o") > F.col("end")), "target").when(F.col("lead").isNotNull(), "duplicate").otherwise("overlap")
    )
    out = out.withColumn("reason", reason)
    return out.select("batch", "ticket_id", F.col("reason").isin("whole", "fits", "filled").alias("kept"), "reason")


def _leading(d: DataFrame, many: Column) -> DataFrame:
    """The first ``many`` rows of each batch by ``o``, ranked in parts of a batch first."""
    part = d.withColumn("_part", F.pmod(F.xxhash64("o"), F.lit(PARTS)))
    rank = lambda *group: F.row_number().over(Window.partitionBy(*group).orderBy("o"))
    near = part.withColumn("_rank", rank("batch", "_part")).where(F.col("_rank") <= many)
    return near.withColumn("_rank", rank("batch")).where(F.col("_rank") <= many).drop("_part", "_rank")
