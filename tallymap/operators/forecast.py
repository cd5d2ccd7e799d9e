"""Forecasts of daily totals with MLlib tree models.

Models are fitted on daily series, at most one row per day; the fact tables
only feed the aggregation before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymap.functions.columns import calendar_cols, per_day, trunc_long
from tallymap.operators.capacity import daily_loads
from tallymap.operators.filters import filter_region
from tallymap.operators.rollup import calendar_totals
from tallymap.operators.trends import growth_7, numbered
from tallymap.sources.scratch import stage
from tallymap.spec import Fact

CALENDAR = ("day_of_year", "month", "day_of_week")


def _training_rows(df: DataFrame, key: str, blocks: int = 1) -> DataFrame:
    """Training rows in few blocks, always the same ones: a fit runs many short jobs over
    some thousand rows."""
    return stage(df.repartition(blocks, key).sortWithinPartitions(key)).coalesce(blocks)


def _bins(n: int) -> int:
    return max(32, n)


def forecast_daily(
    daily: DataFrame,
    horizon: int = 30,
    rounds: int = 100,
    min_days: int = 10,
    seed: int = 42,
    date: str = "date",
) -> DataFrame:
    """Boosted trees over the row index, ``horizon`` days after the last date.

    Trees cannot extrapolate an index, so all predicted days carry the level of
    the last ones.  Series of ``min_days`` or fewer give no rows.
    """
    order = W.orderBy(date)
    rows = _training_rows(
        daily.select(
            date,
            F.col("total").cast("double").alias("label"),
            (F.row_number().over(order) - 1).alias("index"),
        ),
        date,
    )
    n = rows.count()
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    future = rows.agg(F.max(date).alias("last"), F.max("index").alias("end")).select(
        "last", "end", ahead.alias("step")
    )
    future = future.select(
        F.date_add("last", F.col("step")).alias(date), (F.col("end") + F.col("step")).alias("index")
    )
    if n <= min_days:
        return future.select(date, F.lit(None).cast("bigint").alias("predicted_total")).limit(0)
    assemble = VectorAssembler(inputCols=["index"], outputCol="features")
    model = GBTRegressor(
        maxIter=rounds, stepSize=0.1, maxDepth=3, maxBins=_bins(n), seed=seed
    ).fit(assemble.transform(rows).select("features", "label"))
    return model.transform(assemble.transform(future)).select(
        date, trunc_long(F.col("prediction")).alias("predicted_total")
    )


@dataclass
class CalendarModel:
    """Random forest over day of year, month and weekday."""

    model: RandomForestRegressionModel
    rows: DataFrame
    last: DataFrame

    def predict(self, as_of: date | None = None, horizon: int = 7) -> DataFrame:
        """The ``horizon`` days after ``as_of`` (default: last date of the table)."""
        start = F.lit(as_of).cast("date") if as_of else F.col("last")
        days = self.last.select(
            F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, horizon))).alias("date")
        )
        features = days.withColumns(calendar_cols("date"))
        return self.model.transform(_calendar_vector(features)).select(
            "date", trunc_long(F.col("prediction")).alias("predicted_total")
        )

    def importance(self) -> DataFrame:
        weights = [float(w) for w in self.model.featureImportances.toArray()]
        spark = self.rows.sparkSession
        return spark.createDataFrame(list(zip(CALENDAR, weights)), "feature string, importance double")

    def fitted(self) -> DataFrame:
        """Observed and fitted totals of the training rows."""
        return self.model.transform(_calendar_vector(self.rows)).select(
            *CALENDAR, F.col("label").alias("y"), F.col("prediction").alias("y_hat")
        )

    def score(self) -> float:
        return RegressionEvaluator(labelCol="y", predictionCol="y_hat", metricName="r2").evaluate(
            self.fitted()
        )


def _calendar_vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(CALENDAR), outputCol="features").transform(df)


def calendar_model(
    fact: Fact,
    state: str | None = None,
    district: str | None = None,
    trees: int = 100,
    seed: int = 42,
    min_rows: int = 10,
    blocks: int = 4,
) -> CalendarModel | None:
    """Fit on the calendar totals of a region; None with too few rows."""
    # A district counts only together with its state.
    scope = filter_region(fact, state, district if state else None)
    totals = calendar_totals(scope).withColumn("label", F.col("total").cast("double"))
    # Finding splits is the work of a forest, so its rows are spread over several tasks.
    rows = _training_rows(totals.drop("total"), "day_of_year", blocks)
    if rows.count() < min_rows:
        return None
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=30, featureSubsetStrategy="all", maxBins=367, seed=seed,
        cacheNodeIds=True,
    )
    last = stage(scope.df.agg(F.max(fact.spec.date_col).alias("last")))
    return CalendarModel(forest.fit(_calendar_vector(rows)), rows, last)


def model_score(pred: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """R squared of predictions; NULL when y is constant."""
    residual = (F.col(y) - F.col(y_hat)) * (F.col(y) - F.col(y_hat))
    spread = F.var_pop(y) * F.count(y)
    return pred.agg((1 - F.sum(residual) / F.nullif(spread, F.lit(0.0))).alias("r2"))


def flat_projection(
    df: DataFrame, avg_daily: Column, growth: Column, start: Column, months: int = 6
) -> DataFrame:
    """The same monthly amount for each coming month, with falling confidence."""
    step = F.explode(F.sequence(F.lit(1), F.lit(months)))
    amount = F.greatest(F.lit(0.0), avg_daily * 30 * (1 + growth / 100))
    stepped = df.select("*", step.alias("step"), amount.alias("predicted"), start.alias("start"))
    return stepped.withColumns(
        {
            "month": F.add_months("start", F.col("step")),
            "confidence": F.greatest(F.lit(50), 95 - 7 * F.col("step")),
        }
    ).drop("start", "step")


def monthly_projection(fact: Fact, by: Sequence[str] = (), months: int = 6) -> DataFrame:
    """Flat projection of every region from its daily average and weekly growth."""
    date = fact.spec.date_col
    series = numbered(daily_loads(fact, by), by, date)
    base = series.groupBy(*by).agg(
        per_day(F.sum("total"), F.count(date)).alias("avg_daily"),
        F.round(growth_7(), 2).alias("growth"),
        F.max(date).alias("last"),
    )
    out = flat_projection(base, F.col("avg_daily"), F.col("growth"), F.col("last"), months)
    return out.select(*by, "month", "predicted", "confidence")
