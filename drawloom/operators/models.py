"""Models fitted with Spark ML: popularity, position heat, sales forecasts, number chances."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.scalar import shape_features
from .draw_stats import lag_frame
from .order import by, stretched, with_order

#: Features of a combination that players may go by.
POPULARITY = ("total", "span", "odd", "pairs", "low", "longest_run", "share12", "share31", "complexity", "overlap")


def per_game(frame: DataFrame, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fit`` of every game's rows, with the game in front; ``frame`` is kept while the fits pass over it.

    Games are few (a fit each), so their names are all that reaches the driver.
    A game for which ``fit`` gives no rows has none.
    """
    kept = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        games = sorted(r.lottery for r in kept.select("lottery").distinct().collect() if r.lottery is not None)
        parts = [fit(kept.where(F.col("lottery") == g)) for g in games]
        parts = [p.select(F.lit(g).alias("lottery"), *p.columns) for g, p in zip(games, parts, strict=True)]
    finally:
        kept.unpersist()
    if not parts:
        raise ValueError("no game to fit")
    return reduce(DataFrame.unionByName, parts)


def popularity_frame(draws: DataFrame) -> DataFrame:
    """Draws in order with the POPULARITY features, winners and the log of tickets sold."""
    shapes = shape_features(F.col("front"))
    d = stretched(with_order(draws.where("sales > 0")).select("lottery", "ord", "front", "sales", "first_winners"), 1)
    d = d.withColumn("overlap", F.coalesce(F.size(F.array_intersect("front", F.lag("front").over(by()))), F.lit(0))).where("not lead")
    return d.select("lottery", "ord", F.col("first_winners").cast("double").alias("winners"), F.ln(F.col("sales") / 2).alias("offset"), *((shapes[n] if n in shapes else F.col(n)).cast("double").alias(n) for n in POPULARITY))


def fit_popularity(frame: DataFrame) -> DataFrame:
    """(feature, beta, deviance, null_deviance, lr, p) of one game's Poisson model of winners per ticket, on standardised features.

    ``lr`` is the drop of the deviance against the model without features, ``p``
    its chi-square tail.
    """
    assembled = VectorAssembler(inputCols=list(POPULARITY), outputCol="raw").transform(frame)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembled).transform(assembled)
    model = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="offset", labelCol="winners", regParam=1e-8, maxIter=50).fit(scaled)
    deviance, null = float(model.summary.deviance), float(model.summary.nullDeviance)
    rows = [(n, float(b), deviance, null, null - deviance) for n, b in zip(("intercept", *POPULARITY), (model.intercept, *model.coefficients), strict=True)]
    out = frame.sparkSession.createDataFrame(rows, "feature string, beta double, deviance double, null_deviance double, lr double")
    return out.withColumn("p", special.chi2_sf("lr", F.lit(float(len(POPULARITY)))))


def popularity_drift(frame: DataFrame) -> DataFrame:
    """(feature, early, late): the coefficients of the first and second half of one game's draws."""
    middle = frame.agg(F.max("ord") / 2).first()[0]
    early, late = fit_popularity(frame.where(F.col("ord") <= middle)), fit_popularity(frame.where(F.col("ord") > middle))
    return early.select("feature", F.col("beta").alias("early")).join(late.select("feature", F.col("beta").alias("late")), "feature")


def position_heat(series: DataFrame, positions: int = 5, values: int = 10) -> DataFrame:
    """(position, digit, heat): least-squares effects on ln(1 + winners) of the digit at each position, 0 for each position's first digit."""
    cells = [(p, v) for p in range(positions) for v in range(1, values)]
    one_hot = F.array(*((F.get("digits", F.lit(p)) == v).cast("double") for p, v in cells))
    d = series.select(array_to_vector(one_hot).alias("features"), F.log1p(F.col("winners1").cast("double")).alias("label"))
    model = LinearRegression(regParam=0.0, standardization=False).fit(d)
    rows = [(p, v, float(c)) for (p, v), c in zip(cells, model.coefficients, strict=True)] + [(p, 0, 0.0) for p in range(positions)]
    return series.sparkSession.createDataFrame(rows, "position int, digit int, heat double")


def sales_lags(draws: DataFrame) -> DataFrame:
    """The lag frame of the draws that have enough draws before them."""
    return lag_frame(draws).where("ma8 is not null and lag2 is not null")


def forecast_sales(lags: DataFrame, holdout: float = 0.2, trees: int = 20, rows: int = 250_000) -> DataFrame:
    """(model, r2, mae) on the last ``holdout`` of one game's draws (``sales_lags``): boosted trees on lags of log sales, against the mean and the draw before.

    The trees pass over the draws some hundred times, so these are held in
    partitions of up to ``rows`` draws, but at least one a core, and not in the
    many small ones of the shuffles; all scores come from one pass.
    """
    columns = ["lag1", "lag2", "ma4", "ma8", "dry", "wins8", "weekday", "month"]
    d = lags.select("ord", F.col("log_sales").alias("label"), *(F.when(F.lit(c in ("lag1", "lag2", "ma4", "ma8")), F.log1p(F.col(c))).otherwise(F.col(c)).cast("double").alias(c) for c in columns))
    ends = d.agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    cut = ends.hi - (ends.hi - ends.lo) * holdout
    data = VectorAssembler(inputCols=columns, outputCol="features").transform(d)
    train, test = data.where(F.col("ord") <= cut), data.where(F.col("ord") > cut)
    train = train.select("label", "features").coalesce(max(lags.sparkSession.sparkContext.defaultParallelism, -(-ends.n // rows))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean = train.agg(F.avg("label")).first()[0]
        model = GBTRegressor(maxIter=trees, maxDepth=4, seed=1).fit(train)
    finally:
        train.unpersist()
    tested = model.transform(test).select("label", F.col("prediction").alias("trees"), F.lit(mean).alias("mean"), F.col("lag1").alias("before"))
    names = ("trees", "mean", "before")
    off = lambda n: F.col("label") - F.col(n)
    s = tested.agg((F.var_pop("label") * F.count("label")).alias("all"), *(F.sum(off(n) * off(n)).alias(f"{n}2") for n in names), *(F.avg(F.abs(off(n))).alias(n) for n in names)).first()
    r2 = lambda n: 1 - s[f"{n}2"] / s["all"] if s["all"] else -math.inf if s[f"{n}2"] else math.nan
    return lags.sparkSession.createDataFrame([(n, float(r2(n)), float(s[n])) for n in names], "model string, r2 double, mae double")


def number_model(cells: DataFrame, splits: int = 3) -> DataFrame:
    """(fold, n, auc): logistic chances of each number from its count and gap, fitted on strictly older draws and tested on the next block.

    ``cells`` is ``features.number_cells`` of one game: rows with equal features
    and label count by their number, so a fit's work does not grow with the
    draws.  Features are scaled here, since Spark would take the deviation of
    the cells and not of the rows they stand for.
    """
    d = cells.select("block", "freq", "gap", F.col("label").cast("double").alias("label"), F.col("rows").cast("double").alias("weight")).coalesce(1)  # cells are few
    moment = lambda c, k: F.sum(F.pow(F.col(c), F.lit(k)) * F.col("weight"))
    rows = []
    for k in range(1, splits + 1):  # a few fits, each over the cells of its part
        train, test = d.where(F.col("block") < k), d.where(F.col("block") == k)
        s = train.agg(F.sum("weight").alias("n"), *(moment(c, p).alias(f"{c}{p}") for c in ("freq", "gap") for p in (1, 2))).first()
        spread = {c: (max(0.0, s[f"{c}2"] - s[f"{c}1"] ** 2 / s.n) / (s.n - 1)) ** 0.5 or 1.0 for c in ("freq", "gap")}
        scaled = lambda part: part.select(array_to_vector(F.array(*(F.col(c) / w for c, w in spread.items()))).alias("features"), "label", "weight")
        model = LogisticRegression(regParam=1e-4, maxIter=30, standardization=False, weightCol="weight").fit(scaled(train))
        auc = BinaryClassificationEvaluator(weightCol="weight", numBins=0).evaluate(model.transform(scaled(test)))
        rows.append((k, int(test.agg(F.sum("weight")).first()[0]), float(auc)))
    return cells.sparkSession.createDataFrame(rows, "fold int, n long, auc double")
