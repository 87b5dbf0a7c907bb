"""Structured Streaming jobs over event files (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_only(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Each event once: later copies of an id within the horizon are dropped."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Events and value per day and type, final once the watermark has passed."""
    g = events.withWatermark("ts", horizon).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def sliding_counts(events: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Events per seven days, day by day."""
    g = events.withWatermark("ts", horizon).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "5 seconds 1 microsecond", horizon: str = "1 day") -> DataFrame:
    """Batches of a user's events that follow each other within the gap."""
    g = events.withWatermark("ts", horizon).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def settle_stream(predictions: DataFrame, results: DataFrame, wait: str = "14 days", horizon: str = "1 day") -> DataFrame:
    """Each prediction (prediction_id, key, made) with its key's results (key, drawn, outcome) of the ``wait`` after it; missed if none came.

    A missed prediction is put out once the watermark has passed its wait.
    """
    p = predictions.withWatermark("made", horizon)
    r = results.select(F.col("key").alias("_key"), "drawn", "outcome").withWatermark("drawn", horizon)
    within = (F.col("key") == F.col("_key")) & (F.col("drawn") >= F.col("made")) & (F.col("drawn") <= F.col("made") + F.expr(f"interval {wait}"))
    both = p.join(r, within, "left_outer")
    return both.select("prediction_id", "key", "made", "drawn", "outcome", F.when(F.col("_key").isNull(), "missed").otherwise("evaluated").alias("status"))


def _files(spark, path: str):
    """The file system of ``path``, and a maker of its paths."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    return make(path).getFileSystem(hadoop), make


def _recovered(fs, make, path: str) -> bool:
    """Whether there is a table at ``path``, after a swap that was broken off has been finished or taken back."""
    target, fresh, old = (make(path + end) for end in ("", "_new", "_old"))
    if not fs.exists(target):
        if fs.exists(make(path + "_new/_SUCCESS")):
            fs.rename(fresh, target)
        elif fs.exists(old):
            fs.rename(old, target)
    return fs.exists(target)


def upsert_best(batch: DataFrame, path: str, key: list[str], rank: str) -> None:
    """For ``foreachBatch``: the Parquet table at ``path`` with the batch's rows, of each key the one with the least ``rank``, the older of equals.

    The new table is written beside the old one, which is moved aside before the
    new one is moved in.  A job that ends between any two of these steps leaves
    one whole table under one of the three names; the next call puts it right
    first.  A batch that comes again changes nothing.
    """
    spark = batch.sparkSession
    fs, make = _files(spark, path)
    new = batch.withColumn("_new", F.lit(1))
    both = spark.read.parquet(path).withColumn("_new", F.lit(0)).unionByName(new) if _recovered(fs, make, path) else new
    best = both.groupBy(*key).agg(F.min_by(F.struct(*batch.columns), F.struct(rank, "_new")).alias("r")).select("r.*")
    target, fresh, old = (make(path + end) for end in ("", "_new", "_old"))
    fs.delete(old, True)
    best.write.mode("overwrite").parquet(path + "_new")
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def _committed(fs, make, path: str) -> list[int]:
    log = make(f"{path}/_commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(log)) if fs.exists(log) else []


def committed(spark, path: str) -> DataFrame:
    """What ``first_wins`` has written to ``path`` in batches that were ended; batches still being written are not seen."""
    fs, make = _files(spark, path)
    done = _committed(fs, make, path)
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={i}" for i in done)).drop("batch")


def first_wins(batch: DataFrame, path: str, late_path: str, key: list[str], order: str, batch_id: int | None = None) -> None:
    """For ``foreachBatch``: append the rows of new keys (of several the first by ``order``); rows of keys already there, or later ones, go to ``late_path``.

    Every batch has a folder of its number in both tables (without a number, the
    next one) and a mark in ``_commits`` once both are written.  A batch that
    comes again after its mark is left out; one that was broken off writes its
    folders anew, and only what was committed before it counts as known.  So
    nothing is lost or doubled wherever the job ends.
    """
    spark = batch.sparkSession
    fs, make = _files(spark, path)
    done = _committed(fs, make, path)
    batch_id = (done[-1] + 1 if done else 0) if batch_id is None else batch_id
    if batch_id in done:
        return
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    marked = batch.withColumn("_first", rank == 1)
    if done:
        known = committed(spark, path).select(*key).distinct().withColumn("_known", F.lit(True))
        marked = marked.join(known, key, "left").withColumn("_first", F.col("_first") & F.col("_known").isNull()).drop("_known")
    marked.where(~F.col("_first")).drop("_first").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
    marked.where("_first").drop("_first").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    fs.create(make(f"{path}/_commits/{batch_id}"), True).close()


MONITOR = "key string, n long, log_wealth double, crossed long"
STATE = "counts array<long>, n long, logs array<double>, crossed long"


def bet(counts: np.ndarray, n: int, logs: np.ndarray, value: int, warm: int, c: float = 0.3, eps: float = 1e-3) -> np.ndarray:
    """The logs of each value's wealth after one more observation, its bet following from the ``n`` before."""
    p0 = 1 / len(counts)
    if n < warm:
        return logs
    lam = np.clip(c * (counts / n - p0) / (p0 * (1 - p0)), -(1 - eps) / (1 - p0), (1 - eps) / p0)
    return logs + np.log1p(lam * ((np.arange(len(counts)) == value) - p0))


def log_mean(logs: np.ndarray) -> float:
    """The logarithm of the mean of exp(logs), however large they are."""
    top = float(np.max(logs))
    return top + math.log(float(np.mean(np.exp(logs - top))))


def monitor(rows: DataFrame, values: int, warm: int = 50, alpha: float = 0.05) -> DataFrame:
    """A running e-process per key over (key, ts, value in 0..values-1): observations, log of the mean wealth, and at which one it first reached 1 / alpha.

    Put out after every micro-batch that has rows of the key, in order of ``ts``
    within the batch; the state of a key is its counts and logs.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            counts, n, logs, crossed = state.get
            counts, logs = np.array(counts, float), np.array(logs, float)
        else:
            counts, n, logs, crossed = np.zeros(values), 0, np.zeros(values), None
        for value in pd.concat(list(batches)).sort_values("ts", kind="stable")["value"].to_numpy():
            logs = bet(counts, n, logs, int(value), warm)
            counts[int(value)] += 1
            n += 1
            if crossed is None and log_mean(logs) >= math.log(1 / alpha):
                crossed = n
        state.update(([int(x) for x in counts], n, [float(x) for x in logs], crossed))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "log_wealth": [log_mean(logs)], "crossed": pd.array([crossed], dtype="Int64")})

    return rows.groupBy("key").applyInPandasWithState(run, MONITOR, STATE, "update", "NoTimeout")
