"""Mixing sources to target weights by entropy balancing.

Document rates q stay as close to 1 as they can in relative entropy, with q <= 2,
while each source's expected words meet its target.  The solution is tilted
exponentially, q = min(2, exp(lambda_source * size / mean size of the source)),
and Newton's method on the convex dual finds the lambdas: every iteration adds
up gradient and curvature over a (source, size) histogram in Spark and steps
all sources at once, within brackets.  Rates are then rounded into whole
copies so that the running total within a source follows its expectation, and
a last step changes some documents' copies to close the gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_HOT, SPACE_CLASS, stage

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words (percent), and no source or document more than LIMIT times its own.
TOTAL_PERCENT = 150
LIMIT = 2
#: Rows of one (source, size) that are ranked in one task, about.
RANKED = 1 << 18
#: A source's expected words may miss its target by this share; rounds after which the search gives up with an error.
TOLERANCE = 1e-7
ITERATIONS = 120


def text_size(text):
    """Number of words of a text; null has 0."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^"))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to the limits.

    ``sizes`` has one row (source, source_size) per source.  A source's target
    is min(LIMIT * size, theta * weight); theta follows from the sources in the
    order in which they reach their limits.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("cap", (LIMIT * F.col("source_size")).cast("double"))
    df = df.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * (TOTAL_PERCENT / 100)
    all_weight = F.sum("weight").over(Window.partitionBy())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    theta = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("theta", theta).withColumn("free", F.col("ratio") > F.col("theta"))
    level = F.min(F.when(F.col("free"), F.struct("ratio", "theta"))).over(Window.partitionBy())["theta"]
    df = df.withColumn("level", level)
    return df.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _same(a, b):
    return a.eqNullSafe(b)


def rates(histogram: DataFrame, goals: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(source, mean, lambda) from the histogram (source, size, n) and the goals (source, source_size, target)."""
    state = stage(
        goals.where("source_size > 0").join(histogram.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean")), F.expr("source <=> s")).select(
            "source", "target", "source_size", "mean", F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"), (F.col("target") >= LIMIT * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(False).alias("done")
        )
    )
    for _ in range(iterations):
        if state.where("not done").isEmpty():
            return state.select("source", "mean", F.when(F.col("full"), F.lit(1e9)).otherwise(F.col("lam")).alias("lam"))
        h = histogram.withColumnRenamed("source", "hs").where("size > 0")
        x = F.col("size") / F.col("mean")
        q = F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("lam") * x, F.lit(1.0))))
        free = (F.col("lam") * x < F.log(F.lit(float(LIMIT)))).cast("double")
        sums = h.join(state, F.expr("hs <=> source")).groupBy("source").agg(F.sum(F.col("n") * F.col("size") * q).alias("got"), F.sum(F.col("n") * F.col("size") * x * q * free).alias("slope"))
        sums = sums.withColumnRenamed("source", "ss")
        gap = F.col("got") - F.col("target")
        df = state.join(sums, F.expr("ss <=> source"))
        df = df.withColumn("lo2", F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi2", F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        # outside the bracket, or without a slope: halve the bracket, or stride towards an open end
        middle = F.when(F.col("lo2") <= -700, F.col("hi2") - 2 * (1 + F.abs("hi2"))).when(F.col("hi2") >= 700, F.col("lo2") + 2 * (1 + F.abs("lo2"))).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        step = F.when(F.col("done") | F.col("full"), F.col("lam")).when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise(middle)
        done = F.col("full") | (F.abs(gap) <= F.col("target") * TOLERANCE)
        state = stage(df.select("source", "target", "source_size", "mean", F.when(done, F.col("lam")).otherwise(step).alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "full", done.alias("done")))
    raise RuntimeError(f"no rates within {TOLERANCE} of the targets after {iterations} rounds")


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken.

    copies is 0, 1 or 2 and taken = copies * size.  A source's taken words come
    within one document of its target, the shortest that could still change.  Null texts have size 0 and,
    like all texts without words, one copy; a null source is a source like any
    other, last in order.  Repeated rows are documents of their own.  The
    result depends on the rows only, so reruns agree.  No rows give no rows.
    """
    df = stage(docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size")))
    return _copies(df).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, as often as the mix takes them (see ``entropy_mix``)."""
    whole = stage(docs.select(F.monotonically_increasing_id().alias("_mix_key"), text_size(F.col(text_col)).alias("_mix_size"), *docs.columns))
    narrow = whole.select(F.col("_mix_key").alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("_mix_size").alias("size"))
    times = _copies(narrow).where("copies > 0").select(F.col("key").alias("_mix_key"), F.col("copies").alias("_mix_copies"))
    rows = whole.join(times, "_mix_key").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return rows.select(*docs.columns)


def _copies(df: DataFrame) -> DataFrame:
    """(key, id, source, size, source_size, target, copies, taken) of staged rows (key, id, source, size)."""
    salts = max(64, df.count() // RANKED)
    histogram = stage(df.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goals = stage(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    tilt = rates(histogram, goals)
    goals = goals.join(tilt.withColumnRenamed("source", "ts"), F.expr("ts <=> source"), "left").drop("ts")

    # The histogram gives each (source, size) its rate and, by a running sum over
    # falling sizes, the expected copies before it; a document adds its rank.
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(LIMIT)), F.exp(F.least(F.col("lam") * x, F.lit(1.0)))))
    cells = histogram.join(goals.withColumnRenamed("source", "gs"), F.expr("gs <=> source")).drop("gs").withColumn("rate", rate)
    falling = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = stage(cells.withColumn("before", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(falling), F.lit(0.0))).select(F.col("source").alias("cs"), F.col("size").alias("cz"), "source_size", "target", "rate", "before"))

    salted = df.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("source", "size", "salt")
    counts = salted.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.withColumn("skip", F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.join(cells, F.expr("source <=> cs and size = cz")).select(F.col("source").alias("cs"), F.col("size").alias("cz"), F.col("salt").alias("ct"), "skip", "source_size", "target", "rate", "before")
    ranked = salted.withColumn("rank", F.row_number().over(within.orderBy(F.xxhash64("id", F.lit(7)), "id")))
    placed = ranked.join(counts, F.expr("source <=> cs and size = cz and salt = ct")).drop("cs", "cz", "ct")
    upto = lambda k: F.floor(F.round(F.col("before") + F.col("rate") * (F.col("skip") + F.col("rank") - k), 6) + 0.5)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(LIMIT), F.greatest(F.lit(0), upto(0) - upto(1))))
    placed = stage(placed.withColumn("copies", copies.cast("int")))

    # Close the gap: of each source's documents that could take a copy more (or
    # less), as many of each size, largest first, as still fit.
    gaps = placed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("got")).select(F.col("source").alias("gs"), (F.col("target") - F.col("got")).alias("gap"))
    able = placed.where("size > 0").join(F.broadcast(gaps) if gaps.count() <= MAX_HOT else gaps, F.expr("source <=> gs")).withColumn("sign", F.signum("gap").cast("int"))
    able = able.where((F.abs("gap") + 0.5 >= F.col("size")) & (((F.col("sign") > 0) & (F.col("copies") < LIMIT)) | ((F.col("sign") < 0) & (F.col("copies") > 0))))
    able = able.select("key", "source", "size", "salt", "rank", "gap", "sign")
    sizes = able.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.first("gap").alias("gap"), F.first("sign").alias("sign"))
    each = sizes.groupBy("source").agg(F.first("gap").alias("gap"), F.first("sign").alias("sign"), F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("xs"))  # one entry a size
    start = F.struct((F.abs("gap") + 0.5).alias("left"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("chosen"))
    k = lambda left, c: F.least(c["n"], F.floor(left / c["size"]).cast("bigint"))
    fit = lambda acc, c: F.when(k(acc["left"], c) > 0, F.struct((acc["left"] - k(acc["left"], c) * c["size"]).alias("left"), F.array_append(acc["chosen"], F.struct(c["size"].alias("size"), k(acc["left"], c).alias("k"))).alias("chosen"))).otherwise(acc)
    moves = stage(each.select(F.col("source").alias("ms"), F.explode(F.aggregate("xs", start, fit)["chosen"]).alias("c")).select("ms", F.col("c.size").alias("mz"), "c.k"))
    near = able.join(moves, F.expr("source <=> ms and size = mz"))
    upto = near.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("m"))
    upto = upto.select(F.col("source").alias("us"), F.col("size").alias("uz"), F.col("salt").alias("ut"), F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("rank"))
    near = near.withColumn("place", place).join(upto, F.expr("source <=> us and size = uz and salt = ut")).where(F.col("place") + F.col("before") <= F.col("k"))
    out = placed.join(near.select("key", "sign"), "key", "left")
    copies = F.col("copies") + F.coalesce("sign", F.lit(0))
    return out.select("key", "id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
