"""Walk-forward models with an embargo between training rows and the day they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.frames import weekday_before
from tidemark.operators.trees import boosted

#: The last is the z-score of the fractionally differenced log price.
FEATURES = ("mom_12_1", "ret_1m", "vol_60", "vol_252", "fd_z")


def month_ends(panel: DataFrame) -> DataFrame:
    """rebal: the last panel day of each month, but not of the month that the panel stops in."""
    return panel.groupBy(F.last_day("date").alias("m")).agg(F.max("date").alias("rebal")).withColumn("more", F.lead("m").over(W.orderBy("m"))).where("more is not null").select("rebal")


def windows(panel: DataFrame, years: int = 5, embargo: int = 22) -> DataFrame:
    """rebal, train_start, train_end of each month end."""
    return month_ends(panel).select("rebal", F.add_months("rebal", -12 * years).alias("train_start"), weekday_before("rebal", embargo).alias("train_end"))


def by_window(daily: DataFrame, spans: DataFrame) -> DataFrame:
    """daily (date, ...) rows once for each window that their day is in: an equi-join by month, then the exact bounds."""
    months = spans.select("*", F.explode(F.sequence(F.last_day("train_start"), F.last_day("train_end"), F.expr("interval 1 month"))).alias("at")).withColumn("month", F.last_day("at"))
    return daily.withColumn("month", F.last_day("date")).join(months, "month").where(F.col("date").between(F.col("train_start"), F.col("train_end")))


def train_sets(panel: DataFrame, years: int = 5, embargo: int = 22, min_train: int = 1000, min_test: int = 10) -> DataFrame:
    """rebal, train_start, train_end, last_used, n_train, n_test of the months with rows enough. Days are counted first, so that windows join days, not rows."""
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    sets = by_window(days, windows(panel, years, embargo)).groupBy("rebal", "train_start", "train_end").agg(F.max("date").alias("last_used"), F.sum("n").alias("n_train"))
    return sets.join(days.select(F.col("date").alias("rebal"), F.col("n").alias("n_test")), "rebal").where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def walk_forward_ols(panel: DataFrame, feature: str = "mom_12_1", target: str = "target", years: int = 5, embargo: int = 22, min_train: int = 1000, min_test: int = 10) -> DataFrame:
    """date, ticker, prediction by one regression for each month end, from sums by day."""
    x, y = F.col(feature), F.col(target)
    days = panel.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    sets = train_sets(panel, years, embargo, min_train, min_test).select("rebal", "train_start", "train_end")
    sums = by_window(days, sets).groupBy("rebal").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "xy")])
    slope = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x"))
    fitted = sums.withColumn("slope", slope).select(F.col("rebal").alias("date"), "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("n")).alias("intercept"))
    return panel.join(fitted, "date").select("date", "ticker", (F.col("intercept") + F.col("slope") * x).alias("prediction"))


def _learner(trees: int, depth: int, least: int, seed: int):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol="target", predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=0.05, minInstancesPerNode=least, seed=seed)


def _assembled(panel: DataFrame, features: tuple[str, ...]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="features").transform(panel).select("date", "ticker", "features", "target")


def walk_forward_trees(panel: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 100, depth: int = 4, least: int = 50, rate: float = 0.05, bins: int = 64, **protocol) -> DataFrame:
    """date, ticker, prediction of trees that are boosted anew for each month end.

    For windows that a task holds: a month end is one Arrow group, the rows of its training window and those of its
    day, and each row goes to the 60 windows that it is in. ``forest.walk_forward`` has no such bound.
    """
    sets = train_sets(panel, **protocol).select("rebal", "train_start", "train_end")
    rows = panel.select("date", "ticker", *features, "target")
    known = by_window(rows, sets).select("rebal", *rows.columns, F.lit(True).alias("known"))
    asked = rows.join(sets.select("rebal"), F.col("date") == F.col("rebal")).select("rebal", *rows.columns, F.lit(False).alias("known"))

    def one(pdf):
        pdf = pdf.sort_values(["date", "ticker"])
        train, test = pdf[pdf["known"]], pdf[~pdf["known"]]
        x, y, at = (part[list(columns)].to_numpy(float) for part, columns in ((train, features), (train, ["target"]), (test, features)))
        return test[["date", "ticker"]].assign(prediction=boosted(x, y[:, 0], at, trees, depth, least, rate, bins))

    return known.unionByName(asked).groupBy("rebal").applyInPandas(one, "date date, ticker string, prediction double")


def tree_importances(panel: DataFrame, features: tuple[str, ...] = FEATURES, trees: int = 200, depth: int = 4, least: int = 20, seed: int = 0) -> DataFrame:
    """feature, gain by one fit on the whole panel: to look at, not to predict with. No rows for an empty panel."""
    kind = "feature string, gain double"
    data = _assembled(panel, features).persist()
    try:
        if data.isEmpty():
            return panel.sparkSession.createDataFrame([], kind)
        gains = _learner(trees, depth, least, seed).fit(data).featureImportances.toArray()
    finally:
        data.unpersist()
    return panel.sparkSession.createDataFrame([(f, float(g)) for f, g in zip(features, gains)], kind)
