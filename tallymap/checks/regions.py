"""Forecasts of every region, regions of several levels, sketches and monthly cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymap.checks.base import SGN_SUMS, UPD, UPD_SUMS, big, query, rounded
from tallymap.checks.rollups import _compare_sql
from tallymap.checks.series import SPIKE_COLS, SPIKES, _rolled
from tallymap.checks.tables import _region_sql
from tallymap.operators import anomaly, regional, rollup, stats
from tallymap.operators.filters import recent_activity
from tallymap.plans import dashboard, profile
from tallymap.sources import cube, fixtures
from tallymap.sources.scratch import fresh_path
from tallymap.spec import FactSet

# --- one fit for all regions ---------------------------------------------------------------

AHEAD = """
    SELECT state, CAST(last + CAST(i AS INTEGER) AS DATE) AS date, {columns}
    FROM (SELECT state, MAX(date) AS last FROM updates GROUP BY state HAVING COUNT(DISTINCT date) > {least}),
         generate_series(1, {days}) AS g(i)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regional.region_days(fixtures.updates(spark, sf_dir), ["state"])


def _within(predicted: DataFrame, days: DataFrame, low: str, high: str) -> DataFrame:
    """Whether each prediction is inside an extent of its region's totals."""
    extent = days.groupBy("state").agg(F.expr(low).alias("low"), F.expr(high).alias("high"))
    inside = F.col("predicted_total").between(F.col("low"), F.col("high")).alias("inside")
    return predicted.join(extent, "state").select("state", "date", "predicted_total", inside)


@query(AHEAD.format(columns="TRUE AS inside, CAST(1 AS BIGINT) AS levels", least=10, days=30))
def forecast_daily_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any fit: dates after each region's own end, one level a region, within its totals."""
    days = _days(spark, sf_dir)
    ahead = _within(regional.forecast_levels(days, ["state"], rounds=40), days, "min(total)", "max(total)")
    levels = ahead.groupBy("state").agg(F.count_distinct("predicted_total").alias("levels"))
    return ahead.join(levels, "state").select("state", "date", "inside", "levels")


@query(AHEAD.format(columns="TRUE AS inside", least=28, days=30))
def forecast_lagged_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return _within(regional.forecast_lagged(days, ["state"]), days, "0", "2 * max(total)").drop("predicted_total")


@query(
    """SELECT state, COUNT(*) AS n_days, CAST(SUM(total) AS BIGINT) AS actual, TRUE AS lagged_is_closer FROM (
           SELECT state, date, SUM(total) OVER (PARTITION BY state ORDER BY date) AS total FROM daily
           QUALIFY row_number() OVER (PARTITION BY state ORDER BY date DESC) <= 30)
       GROUP BY state""",
    daily=f"SELECT state, date, {big(UPD, 'total')} FROM updates GROUP BY state, date",
)
def forecast_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 30 days held back of each state's running total, which has a trend: lags follow it, a level cannot."""
    running = F.sum("total").over(Window.partitionBy("state").orderBy("date"))
    days = _days(spark, sf_dir).withColumn("total", running)
    tested = regional.backtest(days, ["state"], rounds=20)
    closer = F.col("lagged_error") < F.col("flat_error")
    return tested.select("state", "n_days", "actual", closer.alias("lagged_is_closer"))


@query(AHEAD.format(columns="TRUE AS inside, TRUE AS explains", least=9, days=7))
def calendar_models_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    model = regional.calendar_models(fact, ["state"], trees=10)
    ahead = _within(model.predict(), model.rows, "min(total)", "max(total)")
    explains = F.col("r2").between(0, 1).alias("explains")
    return ahead.join(model.scores(), "state").select("state", "date", "inside", explains)


# --- regions named by two levels -----------------------------------------------------------

# Districts of one name in several states.
GEO = """
    SELECT c_custkey AS pincode, {district} AS district, {state} AS state
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
NAME = "'D' || CAST(n_nationkey % 3 AS VARCHAR)"
BOTH = ("state", "district")
PLACES = [("ASIA", "D1"), ("EUROPE", "D1"), ("ASIA", "D2"), ("EUROPE", "D9"), ("ASIA", "D1")]


def _shared_names(spark: SparkSession, sf_dir: str) -> FactSet:
    number = F.regexp_extract("district", r"(\d+)$", 1).cast("int")
    name = F.concat(F.lit("D"), (number % 3).cast("string"))
    return fixtures.facts(spark, sf_dir).map(lambda f: f.on(f.df.withColumn("district", name)))


@query(
    SPIKES.format(level="state, district"),
    geo=GEO.format(district=NAME, state="r_name"),
    **_rolled("updates", UPD, "state, district", "6 PRECEDING AND CURRENT ROW"),
)
def spike_detection_state_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.spike_detection(_shared_names(spark, sf_dir).demographic, BOTH), SPIKE_COLS)


@query(
    **_compare_sql("district", ["/".join(p) for p in PLACES]),
    geo=GEO.format(district=f"r_name || '/' || {NAME}", state="r_name"),
)
def compare_state_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.compare_entities(_shared_names(spark, sf_dir), BOTH, PLACES)


@query(
    _region_sql()["select"].replace("'state' AS level", "'state/district' AS level"),
    geo=GEO.format(district=NAME, state=f"r_name || '/' || {NAME}"),
    **{k: v for k, v in _region_sql().items() if k != "select"},
)
def region_report_state_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.region_report(_shared_names(spark, sf_dir), BOTH)


# --- statistics with bounded tasks ---------------------------------------------------------

EXTREME = "CASE WHEN pincode % 100 = 7 THEN upd_new * 100000000000 ELSE upd_new END"


@query(
    f"""SELECT 'upd_new' AS measure, MIN(x) AS min, MAX(x) AS max, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1,
               quantile_cont(x, 0.75) AS q3 FROM (SELECT {EXTREME} AS x FROM updates)
        UNION ALL SELECT 'upd_old', MIN(upd_old), MAX(upd_old), quantile_cont(upd_old, 0.5), quantile_cont(upd_old, 0.25),
               quantile_cont(upd_old, 0.75) FROM updates"""
)
def describe_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some values a hundred billion times the others."""
    fact = fixtures.updates(spark, sf_dir)
    far = F.when(F.col("pincode") % 100 == 7, F.col("upd_new") * F.lit(100_000_000_000)).otherwise(F.col("upd_new"))
    return stats.describe_bounded(fact.on(fact.df.withColumn("upd_new", far)), most=64).drop("mean", "std")


# --- sketches and monthly cubes ------------------------------------------------------------

FIRST, LAST = "1995-01-15", "1996-06-20"
BETWEEN = f"date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"


@query(
    f"""SELECT state, COUNT(*) AS records, COUNT(DISTINCT district) AS districts, COUNT(DISTINCT pincode) AS pincodes,
               TRUE AS within FROM updates WHERE {BETWEEN} GROUP BY state"""
)
def approx_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct places of a range of dates from daily sketches, within 3 % of the exact counts next to them."""
    fact = fixtures.updates(spark, sf_dir)
    path = fresh_path(spark, "sketches")
    cube.save_sketches(fact, path)
    about = cube.approx_coverage(cube.open_sketches(spark, path, FIRST, LAST), ["state"])
    exact = rollup.coverage(fact.on(fact.df.where(F.col("date").between(FIRST, LAST))), ["state"])
    near = lambda c: F.abs(F.col(f"a.{c}") - F.col(f"e.{c}")) <= 0.03 * F.col(f"e.{c}")
    both = about.alias("a").join(exact.alias("e"), "state")
    return both.select(
        "state", "records", "e.districts", "e.pincodes", (near("districts") & near("pincodes")).alias("within")
    )


@query(
    " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, CAST({p} AS DOUBLE) AS probability, COUNT({m}) AS n, TRUE AS within
            FROM updates WHERE {BETWEEN}"""
        for m in ("upd_new", "upd_old")
        for p in (0.25, 0.5, 0.9)
    )
)
def approx_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of single records from daily sketches, their ranks within 2 % of those asked for."""
    fact = fixtures.updates(spark, sf_dir)
    path = fresh_path(spark, "sketches")
    cube.save_sketches(fact, path)
    about = cube.approx_quantiles(cube.open_sketches(spark, path, FIRST, LAST), (), (0.25, 0.5, 0.9))
    counts = stats.value_counts(fact.df.where(F.col("date").between(FIRST, LAST)), fact.spec.measures)
    ranks = about.withColumnRenamed("value", "q").join(counts, "measure").groupBy("measure", "probability").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value") < F.col("q"), F.col("n")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("value") <= F.col("q"), F.col("n")).otherwise(0)).alias("upto"),
    )
    p, n = F.col("probability"), F.col("n")
    within = (F.col("below") <= (p + 0.02) * n) & (F.col("upto") >= (p - 0.02) * n)
    return ranks.select("measure", "probability", "n", within.alias("within"))


@query(
    f"""SELECT state, {SGN_SUMS}, {big('sgn_first + sgn_act + sgn_look', 'total')} FROM signups
        WHERE date >= (SELECT MAX(date) FROM signups) - 20 GROUP BY state"""
)
def monthly_cube_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube written in two goes, the second appended; only recent folders are read."""
    fact = fixtures.signups(spark, sf_dir)
    path = fresh_path(spark, "monthly")
    second = F.dayofmonth("date") % 2 == 0
    cube.save_monthly_cube(fact.on(fact.df.where(~second)), path)
    cube.save_monthly_cube(fact.on(fact.df.where(second)), path, append=True)
    return rollup.rollup_by(recent_activity(cube.open_monthly_cube(spark, fact.spec, path), days=20), ["state"])


@query(f"SELECT state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state")
def monthly_cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    path = fresh_path(spark, "monthly")
    cube.save_monthly_cube(fact, path)
    return rollup.rollup_by(cube.open_monthly_cube(spark, fact.spec, path), ["state"])
