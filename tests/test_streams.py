from pyspark.sql import functions as F

from drawloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = jobs.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.day), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(jobs.daily_counts(batch))


def test_first_only_drops_later_copies(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).limit(50)
    batch.union(batch).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = jobs.first_only(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 50


def _run(stream, sink, path):
    q = sink(stream.writeStream.option("checkpointLocation", str(path))).trigger(availableNow=True).start()
    q.awaitTermination()


def test_settle_stream_marks_missed(spark, tmp_path):
    make = lambda rows, name, ddl: spark.createDataFrame(rows, ddl).selectExpr(*[f"cast({c.split()[0]} as timestamp) as {c.split()[0]}" if c.split()[0] in ("made", "drawn") else c.split()[0] for c in ddl.split(", ")]).write.mode("append").parquet(str(tmp_path / name))
    p, r = "prediction_id long, key string, made string", "key string, drawn string, outcome double"
    make([(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 10:00:00")], "p", p)
    make([("a", "2024-01-05 10:00:00", 7.0), ("b", "2024-01-20 10:00:00", 8.0)], "r", r)
    read = lambda name: spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name))
    run = lambda: _run(jobs.settle_stream(read("p"), read("r")), lambda w: w.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), tmp_path / "c")
    run()
    make([(3, "z", "2024-03-01 10:00:00")], "p", p)
    make([("z", "2024-03-01 11:00:00", 1.0)], "r", r)
    run()
    make([(4, "y", "2024-03-20 10:00:00")], "p", p)
    make([("y", "2024-03-20 11:00:00", 1.0)], "r", r)
    run()
    got = {x.prediction_id: (x.status, x.outcome) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == ("evaluated", 7.0) and got[2] == ("missed", None) and got[3] == ("evaluated", 1.0)


def test_monitor_in_batches_equals_one_pass(spark, tmp_path):
    import numpy as np

    rows = [("g", i, (i * 7 + i // 3) % 4 if i < 150 else 1) for i in range(400)]
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], "key string, ts long, value int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts long, value int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.monitor(stream, 4).writeStream.format("memory").queryName("monitor").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("monitor").orderBy("n").collect()[-1]
    counts, logs, crossed = np.zeros(4), np.zeros(4), None
    for n, (_, _, v) in enumerate(rows):
        logs = jobs.bet(counts, n, logs, v, 50)
        counts[v] += 1
        if crossed is None and np.mean(np.exp(logs)) >= 20:
            crossed = n + 1
    assert last.n == 400 and abs(last.log_wealth - np.log(np.mean(np.exp(logs)))) < 1e-9 and last.crossed == crossed and crossed > 150


def test_first_settlement_wins(spark, tmp_path):
    out, late = str(tmp_path / "out"), str(tmp_path / "late")
    make = lambda rows: spark.createDataFrame(rows, "issue long, amount long, at long")
    jobs.first_wins(make([(1, 10, 1), (1, 11, 2), (2, 20, 1)]), out, late, ["issue"], "at")
    jobs.first_wins(make([(1, 99, 3), (3, 30, 4)]), out, late, ["issue"], "at")
    assert sorted((r.issue, r.amount) for r in spark.read.parquet(out).collect()) == [(1, 10), (2, 20), (3, 30)]
    assert sorted((r.issue, r.amount) for r in spark.read.parquet(late).collect()) == [(1, 11), (1, 99)]


def test_upsert_keeps_the_best_source(spark, tmp_path):
    path = str(tmp_path / "best")
    make = lambda rows: spark.createDataFrame(rows, "issue long, source string, rank int")
    jobs.upsert_best(make([(1, "csv", 3), (2, "agg", 2)]), path, ["issue"], "rank")
    jobs.upsert_best(make([(1, "official", 1), (2, "csv", 3), (3, "csv", 3)]), path, ["issue"], "rank")
    assert sorted((r.issue, r.source) for r in spark.read.parquet(path).collect()) == [(1, "official"), (2, "agg"), (3, "csv")]


class Ended(Exception):
    pass


def _broken_off(monkeypatch, spark, step, run):
    """Runs ``run``, which ends before the ``step``-th change of a file or table; says whether it ended early."""
    from pyspark.sql.readwriter import DataFrameWriter

    left, files, write = [step], jobs._files, DataFrameWriter.parquet

    def tick():
        left[0] -= 1
        if left[0] < 0:
            raise Ended

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name in ("rename", "delete", "create"):
                tick()
            return getattr(self.fs, name)

    def parquet(self, path, *a, **k):
        tick()
        return write(self, path, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(jobs, "_files", lambda s, p: (Fs(files(s, p)[0]), files(s, p)[1]))
        m.setattr(DataFrameWriter, "parquet", parquet)
        try:
            run()
        except Ended:
            return True
    return False


def test_upsert_survives_an_end_between_any_two_steps(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "issue long, source string, rank int")
    for step in range(8):
        path = str(tmp_path / f"best{step}")
        jobs.upsert_best(make([(i, "csv", 3) for i in range(10)]), path, ["issue"], "rank")
        again = lambda path=path: jobs.upsert_best(make([(3, "official", 1), (11, "agg", 2)]), path, ["issue"], "rank")
        ended = _broken_off(monkeypatch, spark, step, again)
        again()
        got = {r.issue: r.source for r in spark.read.parquet(path).collect()}
        assert got == {**dict.fromkeys(range(10), "csv"), 3: "official", 11: "agg"}
    assert not ended


def test_first_settlements_survive_an_end_between_any_two_steps(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "issue long, amount long, at long")
    for step in range(5):
        out, late = str(tmp_path / f"o{step}"), str(tmp_path / f"l{step}")
        jobs.first_wins(make([(1, 10, 1), (2, 20, 1)]), out, late, ["issue"], "at", 0)
        again = lambda out=out, late=late: jobs.first_wins(make([(1, 99, 3), (3, 30, 4), (3, 31, 5)]), out, late, ["issue"], "at", 1)
        ended = _broken_off(monkeypatch, spark, step, again)
        if ended:
            assert sorted((r.issue, r.amount) for r in jobs.committed(spark, out).collect()) == [(1, 10), (2, 20)]
        again()
        again()
        for read in (jobs.committed, lambda s, p: s.read.parquet(p)):
            assert sorted((r.issue, r.amount) for r in read(spark, out).collect()) == [(1, 10), (2, 20), (3, 30)]
        assert sorted((r.issue, r.amount) for r in spark.read.parquet(late).collect()) == [(1, 99), (3, 31)]
    assert not ended


def test_wealth_beyond_any_number():
    import numpy as np

    assert jobs.log_mean(np.array([2000.0, 0.0])) == 2000 - np.log(2) and jobs.log_mean(np.zeros(3)) == 0.0
