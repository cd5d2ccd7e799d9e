"""Forecasts of the daily totals of every region at once, each from one fit over all regions.

The facts are read once, into a staged table with a row per region and day; fits and
predictions work on that.  Totals are scaled by their region, so that large and small regions
learn from each other, and what tells regions apart are numbers about them, not their names: a
fit takes as many regions as there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymap.functions.columns import calendar_cols, trunc_long
from tallymap.operators.forecast import model_score
from tallymap.operators.rollup import rollup_by
from tallymap.sources.scratch import stage
from tallymap.spec import Fact

LAGS = (1, 2, 3, 4, 5, 6, 7, 14)
MEANS = (7, 28)
MEMORY = max(*LAGS, *MEANS)


def daily_by(fact: Fact, by: Sequence[str]) -> DataFrame:
    """(regions, date, total) for every region and day, one scan of the facts."""
    date = fact.spec.date_col
    return rollup_by(fact, [*by, date]).select(*by, F.col(date).alias("date"), "total")


def region_days(fact: Fact, by: Sequence[str]) -> DataFrame:
    """``daily_by`` as a table in the shared folder."""
    return stage(daily_by(fact, by), "region-days")


def _scaled(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Days with their region's extent and ``z``, the distance from its mean in deviations; ``age`` is 0 on its last day.

    A window holds the days of one region.
    """
    region = W.partitionBy(*by)
    amount = F.col("total").cast("double")
    extent = days.withColumns(
        {
            "n_days": F.count(F.lit(1)).over(region),
            "mean": F.avg(amount).over(region),
            "std": F.stddev_pop(amount).over(region),
            "low": F.min("total").over(region),
            "high": F.max("total").over(region),
            "last": F.max("date").over(region),
            "age": F.row_number().over(region.orderBy(F.desc("date"))) - 1,
        }
    )
    return extent.withColumn("z", F.coalesce((amount - F.col("mean")) / F.nullif("std", F.lit(0.0)), F.lit(0.0)))


LEVELS = ("age", "recent_7", "recent_30", "size", "spread")


def _with_levels(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scaled days with numbers about their region: its last levels, its size and how much it varies."""
    region = W.partitionBy(*by)
    recent = {f"recent_{n}": F.avg(F.when(F.col("age") < n, F.col("z"))).over(region) for n in (7, 30)}
    return _scaled(days, by).withColumns(
        {
            **recent,
            "size": F.log1p("mean"),
            "spread": F.coalesce(F.col("std") / F.nullif("mean", F.lit(0.0)), F.lit(0.0)),
        }
    )


def _vector(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)


def _ahead(df: DataFrame, by: Sequence[str], horizon: int) -> DataFrame:
    day = F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon)))
    return df.select(*by, day.alias("date"), "predicted_total")


def forecast_levels(
    days: DataFrame,
    by: Sequence[str],
    horizon: int = 30,
    rounds: int = 100,
    min_days: int = 10,
    seed: int = 42,
) -> DataFrame:
    """(regions, date, predicted_total): the level every region ends with, carried on from its own last date.

    Boosted trees over the days' distance from the region's end and the region's numbers.  As trees cannot extrapolate, all
    days ahead of a region have one level, inside the range of its totals.  Regions of ``min_days``
    or fewer days give no rows.  Runs a fit when called.
    """
    rows = stage(_with_levels(days, by).where(F.col("n_days") > min_days), "region-levels")
    ends = rows.where("age = 0").withColumn("age", F.lit(-1))
    if rows.isEmpty():
        return _ahead(ends.withColumn("predicted_total", F.col("total")), by, horizon)
    training = _vector(rows, LEVELS).select("features", F.col("z").alias("label"))
    model = GBTRegressor(maxIter=rounds, stepSize=0.1, maxDepth=3, maxBins=128, seed=seed).fit(training)
    level = F.col("mean") + F.col("prediction") * F.col("std")
    inside = F.least(F.greatest(level, F.col("low").cast("double")), F.col("high").cast("double"))
    found = model.transform(_vector(ends, LEVELS)).withColumn("predicted_total", trunc_long(inside))
    return _ahead(found, by, horizon)


def _lag_columns(by: Sequence[str]) -> dict[str, Column]:
    order = W.partitionBy(*by).orderBy("date")
    lags = {f"lag_{n}": F.lag("level", n).over(order) for n in LAGS}
    return lags | {f"mean_{n}": F.avg("level").over(order.rowsBetween(-n, -1)) for n in MEANS}


def _weekday_columns(date: Column) -> dict[str, Column]:
    return {f"day_{k}": (F.weekday(date) == k).cast("double") for k in range(6)}


def _weighted(weights: dict[str, float], values: dict[str, Column], start: Column) -> Column:
    return reduce(lambda total, n: total + F.lit(weights[n]) * values[n], values, start)


def forecast_lagged(
    days: DataFrame, by: Sequence[str], horizon: int = 30, ridge: float = 1e-6, min_days: int = MEMORY
) -> DataFrame:
    """(regions, date, predicted_total) from the days before and the weekday, each prediction feeding the next.

    A linear model over lags, running means and weekdays of levels (totals over their region's mean), fitted to all
    regions at once, so it can follow a trend.  The steps of a region are one expression over its last
    ``MEMORY`` levels.  Predictions stay between zero and twice the region's largest total.  Lags count a
    region's days in order.  Regions of ``min_days`` or fewer days give no rows.  Runs a fit when called.
    """
    region = W.partitionBy(*by)
    mean = F.nullif(F.avg(F.col("total").cast("double")).over(region), F.lit(0.0))
    base = days.withColumns(
        {
            "n_days": F.count(F.lit(1)).over(region),
            "mean": mean,
            "level": F.coalesce(F.col("total") / mean, F.lit(0.0)),
        }
    ).where(F.col("n_days") > max(min_days, MEMORY))
    names = [*_lag_columns(by), *_weekday_columns(F.col("date"))]
    rows = stage(base.withColumns(_lag_columns(by)).withColumns(_weekday_columns(F.col("date"))), "region-lags")
    back = F.reverse(F.array_sort(F.collect_list(F.when(F.col("age") < MEMORY, F.struct("date", "level")))))
    aged = rows.withColumn("age", F.row_number().over(region.orderBy(F.desc("date"))) - 1)
    ends = aged.groupBy(*by).agg(
        back.alias("back"), F.max("date").alias("last"), F.max("total").alias("high"), F.first("mean").alias("mean")
    )
    known = rows.where(F.col(f"lag_{max(LAGS)}").isNotNull())
    if known.isEmpty():
        return _ahead(ends.withColumn("predicted_total", F.col("high")), by, horizon)
    training = _vector(known, names).select("features", F.col("level").alias("label"))
    model = LinearRegression(regParam=ridge, maxIter=100, solver="normal").fit(training)
    weights = dict(zip(names, (float(w) for w in model.coefficients), strict=True))
    ceiling = F.coalesce(2 * F.col("high") / F.col("mean"), F.lit(0.0))

    def step(levels: Column, k: Column) -> Column:
        recent = lambda n: F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda s, x: s + x) / n
        values = {f"lag_{n}": F.get(levels, F.lit(n - 1)) for n in LAGS} | {f"mean_{n}": recent(n) for n in MEANS}
        values |= _weekday_columns(F.date_add("last", k))
        level = _weighted(weights, values, F.lit(float(model.intercept)))
        return F.concat(F.array(F.least(F.greatest(level, F.lit(0.0)), ceiling)), levels)

    levels = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon)), F.transform("back", lambda b: b["level"].cast("double")), step
    )
    # Newest first: the last step stands in front.
    made = ends.select(*by, "last", "mean", F.posexplode(F.reverse(F.slice(levels, 1, horizon))).alias("k", "level"))
    total = F.coalesce(F.col("level") * F.col("mean"), F.lit(0.0))
    return made.select(*by, F.date_add("last", F.col("k") + 1).alias("date"), trunc_long(F.round(total)).alias("predicted_total"))


def backtest(days: DataFrame, by: Sequence[str], horizon: int = 30, rounds: int = 100) -> DataFrame:
    """(regions, n_days, actual, flat_error, lagged_error): mean absolute errors on each region's last ``horizon`` days.

    Both forecasts are fitted without those days and compared with them in order, the first day held back with the first
    one ahead.  Regions that a forecast leaves out are left out.
    """
    age = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("date")))
    aged = stage(days.withColumn("age", age), "backtest")
    before = aged.where(F.col("age") > horizon).drop("age")
    held = aged.where(F.col("age") <= horizon).select(*by, (horizon + 1 - F.col("age")).alias("step"), "total")
    step = F.row_number().over(W.partitionBy(*by).orderBy("date")).alias("step")
    flat = forecast_levels(before, by, horizon, rounds).select(*by, step, F.col("predicted_total").alias("flat"))
    lagged = forecast_lagged(before, by, horizon).select(*by, step, F.col("predicted_total").alias("lagged"))
    keys = [*by, "step"]
    both = held.join(flat, keys).join(lagged, keys)
    error = lambda c: F.avg(F.abs(F.col("total") - F.col(c)))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("total").alias("actual"),
        error("flat").alias("flat_error"),
        error("lagged").alias("lagged_error"),
    )


SEASONS = ("day_of_year", "month", "day_of_week", "month_level", "weekday_level")


@dataclass(frozen=True)
class RegionalCalendar:
    """Forest over the calendar and each region's own levels of a month and of a weekday.

    ``rows`` are the training rows, ``regions`` the extent of each region; both are staged.
    """

    model: Model
    by: tuple[str, ...]
    rows: DataFrame
    regions: DataFrame

    def predict(self, horizon: int = 7) -> DataFrame:
        """(regions, date, predicted_total) of the days after each region's last date, inside the range of its totals."""
        day = F.explode(F.sequence(F.date_add("last", 1), F.date_add("last", horizon))).alias("date")
        days = self.regions.select(*self.by, "mean", "low", "high", day).withColumns(calendar_cols("date"))
        for part, level in (("month", "month_level"), ("day_of_week", "weekday_level")):
            known = self.rows.groupBy(*self.by, part).agg(F.first(level).alias(level))
            days = days.join(known, [*self.by, part], "left")
        filled = days.fillna(0.0, ["month_level", "weekday_level"])  # a month the region has no rows of is an average one
        made = self.model.transform(_vector(filled, SEASONS))
        # Leaves are shared by all regions; a region's own extent bounds what is said of it.
        amount = F.least(F.greatest(F.col("prediction") * F.col("mean"), "low"), "high")
        return made.select(*self.by, "date", trunc_long(amount).alias("predicted_total"))

    def fitted(self) -> DataFrame:
        made = self.model.transform(_vector(self.rows, SEASONS))
        return made.select(*self.by, F.col("total").alias("y"), (F.col("prediction") * F.col("mean")).alias("y_hat"))

    def scores(self) -> DataFrame:
        """(regions, r2): how much of a region's own variation the fit explains; NULL for a constant one."""
        return model_score_by(self.fitted(), self.by)

    def score(self) -> DataFrame:
        return model_score(self.fitted())

    def importance(self) -> DataFrame:
        weights = [float(w) for w in self.model.featureImportances.toArray()]
        return self.rows.sparkSession.createDataFrame(list(zip(SEASONS, weights)), "feature string, importance double")


def model_score_by(pred: DataFrame, by: Sequence[str], y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """R squared of each region's predictions; NULL when y is constant there."""
    residual = (F.col(y) - F.col(y_hat)) * (F.col(y) - F.col(y_hat))
    spread = F.var_pop(y) * F.count(y)
    return pred.groupBy(*by).agg((1 - F.sum(residual) / F.nullif(spread, F.lit(0.0))).alias("r2"))


def calendar_models(
    fact: Fact, by: Sequence[str], trees: int = 50, depth: int = 12, seed: int = 42, min_rows: int = 10
) -> RegionalCalendar | None:
    """One fit over the calendar totals of every region with ``min_rows`` rows or more; None without any.

    The facts are read once.
    """
    days = region_days(fact, by)
    parts = calendar_cols("date")
    totals = days.groupBy(*by, *[c.alias(n) for n, c in parts.items()]).agg(
        F.sum("total").alias("total"), F.max("date").alias("latest")
    )
    region = W.partitionBy(*by)
    mean = F.avg(F.col("total").cast("double")).over(region)
    sized = totals.withColumns({"n": F.count(F.lit(1)).over(region), "mean": mean, "last": F.max("latest").over(region)})
    level = F.coalesce(F.col("total") / F.nullif("mean", F.lit(0.0)), F.lit(0.0))
    kept = sized.where(F.col("n") >= min_rows).withColumn("label", level)
    own = lambda part: F.avg("label").over(W.partitionBy(*by, part)) - F.avg("label").over(region)
    rows = stage(
        kept.withColumns({"month_level": own("month"), "weekday_level": own("day_of_week")}), "calendar-rows"
    )
    if rows.isEmpty():
        return None
    forest = RandomForestRegressor(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", maxBins=367, seed=seed, cacheNodeIds=True
    )
    model = forest.fit(_vector(rows, SEASONS).select("features", "label"))
    extent = [F.min(F.col("total").cast("double")).alias("low"), F.max(F.col("total").cast("double")).alias("high")]
    regions = rows.groupBy(*by).agg(F.max("last").alias("last"), F.max("mean").alias("mean"), *extent)
    return RegionalCalendar(model, tuple(by), rows, stage(regions, "calendar-regions"))
