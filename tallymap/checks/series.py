"""Time series, anomalies and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap import Fact
from tallymap.checks.base import REN, REN_SUMS, SGN, SGN_SUMS, UPD, UPD_SUMS, big, query, rounded
from tallymap.checks.tables import SPIKE_CTES
from tallymap.operators import anomaly, rollup, stats, trends
from tallymap.sources import fixtures

DAILY = f"SELECT date, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY date"
DAILY_STATE = f"SELECT date, state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY date, state"


def _numbered(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY date) AS rn, COUNT(*) OVER ({part}) AS n FROM {source}"""


def _growth(first_row: str, least: int, digits: int = 4) -> str:
    older = f"AVG(total) FILTER (rn BETWEEN {first_row} AND {first_row} + 6)"
    return f"""CASE WHEN MAX(n) > {least} AND {older} > 0
                    THEN ROUND((AVG(total) FILTER (rn > n - 7) - {older}) / {older} * 100, {digits})
                    ELSE 0.0 END"""


@query(
    """SELECT date, upd_new, upd_old, total,
              ROUND(AVG(total) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg_7,
              ROUND(AVG(total) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS avg_30
       FROM daily""",
    daily=DAILY,
)
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_totals(fixtures.updates(spark, sf_dir))
    return rounded(trends.moving_averages(series), ["avg_7", "avg_30"])


@query(
    """SELECT date, district, ren_done, ren_open, total,
              ROUND(AVG(total) OVER (PARTITION BY district ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg_7,
              ROUND(AVG(total) OVER (PARTITION BY district ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 4) AS avg_30
       FROM daily""",
    daily=f"SELECT date, district, {REN_SUMS}, {big(REN, 'total')} FROM renewals GROUP BY date, district",
)
def moving_averages_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_by_region(fixtures.renewals(spark, sf_dir), "district")
    return rounded(trends.moving_averages(series, by=["district"]), ["avg_7", "avg_30"])


@query(
    """SELECT date, state, upd_new, upd_old, total,
              ROUND(AVG(total) OVER w, 4) AS rolling_avg, ROUND(STDDEV_SAMP(total) OVER w, 4) AS rolling_std
       FROM daily WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    daily=DAILY_STATE,
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_by_region(fixtures.updates(spark, sf_dir))
    return rounded(trends.rolling_stats(series), ["rolling_avg", "rolling_std"])


@query(f"SELECT {_growth('greatest(1, n - 36)', 30)} AS growth FROM numbered", daily=DAILY, numbered=_numbered("daily"))
def growth_rate_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_totals(fixtures.updates(spark, sf_dir))
    return rounded(trends.growth_rate_30(series), ["growth"])


@query(
    f"SELECT pincode, {_growth('greatest(1, n - 36)', 30)} AS growth FROM numbered GROUP BY pincode",
    daily=f"SELECT date, pincode, {big(UPD, 'total')} FROM updates GROUP BY date, pincode",
    numbered=_numbered("daily", "pincode"),
)
def growth_rate_30_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_by_region(fixtures.updates(spark, sf_dir), "pincode")
    return rounded(trends.growth_rate_30(series, ["pincode"]), ["growth"])


@query(f"SELECT {_growth('1', 7)} AS growth FROM numbered", daily=DAILY, numbered=_numbered("daily"))
def growth_rate_7(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_totals(fixtures.updates(spark, sf_dir))
    return rounded(trends.growth_rate_7(series), ["growth"])


@query(
    f"SELECT pincode, {_growth('1', 7)} AS growth FROM numbered GROUP BY pincode",
    daily=f"SELECT date, pincode, {big(REN, 'total')} FROM renewals GROUP BY date, pincode",
    numbered=_numbered("daily", "pincode"),
)
def growth_rate_7_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_by_region(fixtures.renewals(spark, sf_dir), "pincode")
    return rounded(trends.growth_rate_7(series, ["pincode"]), ["growth"])


@query(
    """SELECT pincode, CASE WHEN COUNT(*) <= 1 THEN 'stable'
              WHEN AVG(k) FILTER (rn > n - 7) > AVG(k) FILTER (rn <= 7) THEN 'increasing'
              WHEN AVG(k) FILTER (rn > n - 7) < AVG(k) FILTER (rn <= 7) THEN 'decreasing'
              ELSE 'stable' END AS trend
       FROM numbered GROUP BY pincode""",
    daily="SELECT date, pincode, COUNT(*) AS k FROM signups GROUP BY date, pincode",
    numbered=_numbered("daily", "pincode"),
)
def trend_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = trends.record_series(fixtures.signups(spark, sf_dir), ["pincode"])
    return trends.trend_label(counts, ["pincode"])


PEAKS = {
    "ranked": """SELECT *, row_number() OVER (PARTITION BY pincode ORDER BY total DESC, date) AS hi,
                        row_number() OVER (PARTITION BY pincode ORDER BY total, date) AS lo FROM daily"""
}


@query(
    """SELECT pincode, MAX(date) FILTER (hi = 1) AS peak_date, MAX(total) AS peak,
              MAX(date) FILTER (lo = 1) AS low_date, MIN(total) AS low FROM ranked GROUP BY pincode""",
    daily=f"SELECT date, pincode, {big(SGN, 'total')} FROM signups GROUP BY date, pincode",
    **PEAKS,
)
def peak_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = rollup.daily_by_region(fixtures.signups(spark, sf_dir), "pincode")
    return trends.peak_low(series, ["pincode"])


def _report_sql(by: str = "") -> dict[str, str]:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return {
        "select": f"""
            SELECT {key}COUNT(*) AS n_days, ROUND(AVG(total), 4) AS average, ROUND(STDDEV_SAMP(total), 4) AS volatility,
                   MAX(date) FILTER (hi = 1) AS peak_date, MAX(total) AS peak,
                   MAX(date) FILTER (lo = 1) AS low_date, MIN(total) AS low,
                   {_growth('greatest(1, n - 36)', 30)} AS growth
            FROM ranked {'GROUP BY ' + by if by else ''} HAVING COUNT(*) >= 7""",
        "daily": f"SELECT {key}date, {big(UPD, 'total')} FROM updates GROUP BY {key}date",
        "ranked": f"""
            SELECT *, row_number() OVER ({part} ORDER BY date) AS rn, COUNT(*) OVER ({part}) AS n,
                   row_number() OVER ({part} ORDER BY total DESC, date) AS hi,
                   row_number() OVER ({part} ORDER BY total, date) AS lo FROM daily""",
    }


@query(**_report_sql())
def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = trends.trend_report(fixtures.updates(spark, sf_dir))
    return rounded(report, ["average", "volatility", "growth"])


@query(**_report_sql("pincode"))
def trend_report_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = trends.trend_report(fixtures.updates(spark, sf_dir), ["pincode"])
    return rounded(report, ["average", "volatility", "growth"])


@query(f"""
    SELECT 'updates' AS dataset, date, {UPD_SUMS}, CAST(NULL AS BIGINT) AS sgn_first, CAST(NULL AS BIGINT) AS sgn_act,
           CAST(NULL AS BIGINT) AS sgn_look, {big(UPD, 'total')} FROM updates GROUP BY date
    UNION ALL SELECT 'signups', date, NULL, NULL, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY date""")
def time_series_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.time_series_panel(fixtures.facts(spark, sf_dir))


# --- anomalies -----------------------------------------------------------------------------

Z_CTES = {
    "daily": DAILY,
    "scored": """SELECT d.*, mean, std, (total - mean) / NULLIF(std, 0) AS z
                 FROM daily d, (SELECT AVG(total) AS mean, STDDEV_SAMP(total) AS std FROM daily)""",
}


@query(
    """SELECT date, upd_new, upd_old, total, ROUND(mean, 4) AS mean, ROUND(std, 4) AS std, ROUND(z, 4) AS z_score
       FROM scored WHERE abs(z) > 2""",
    **Z_CTES,
)
def zscore_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.zscore_anomalies(fixtures.updates(spark, sf_dir))
    return rounded(found, ["mean", "std", "z_score"])


SPIKES = """
    SELECT date, {level}, total AS value, ROUND(rolling_avg, 4) AS rolling_avg, ROUND(rolling_std, 4) AS rolling_std,
           ROUND((total - rolling_avg) / NULLIF(rolling_avg, 0) * 100, 4) AS deviation,
           CASE WHEN total > rolling_avg + 3 * rolling_std THEN 'high' ELSE 'medium' END AS severity
    FROM rolled WHERE days >= 7 AND total > rolling_avg + 2 * rolling_std"""
SPIKE_COLS = ["rolling_avg", "rolling_std", "deviation"]


@query(SPIKES.format(level="state"), **SPIKE_CTES)
def spike_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.spike_detection(fixtures.updates(spark, sf_dir)), SPIKE_COLS)


def _rolled(fact: str, expr: str, level: str, frame: str) -> dict[str, str]:
    return {
        "daily": f"SELECT date, {level}, {big(expr, 'total')} FROM {fact} GROUP BY date, {level}",
        "rolled": f"""
            SELECT *, AVG(total) OVER w AS rolling_avg, STDDEV_SAMP(total) OVER w AS rolling_std,
                   COUNT(*) OVER (PARTITION BY {level}) AS days
            FROM daily WINDOW w AS (PARTITION BY {level} ORDER BY date ROWS BETWEEN {frame})""",
    }


@query(
    SPIKES.format(level="state"),
    **_rolled("renewals", REN, "state", "7 PRECEDING AND 1 PRECEDING"),
)
def spike_detection_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.spike_detection(fixtures.renewals(spark, sf_dir), baseline="prior")
    return rounded(found, SPIKE_COLS)


@query(
    SPIKES.format(level="district"),
    **_rolled("updates", UPD, "district", "6 PRECEDING AND CURRENT ROW"),
)
def spike_detection_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(anomaly.spike_detection(fixtures.updates(spark, sf_dir), "district"), SPIKE_COLS)


@query(SPIKES.format(level="state") + " ORDER BY deviation DESC, date, state LIMIT 20", **SPIKE_CTES)
def ranked_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = anomaly.spike_detection(fixtures.updates(spark, sf_dir))
    return rounded(anomaly.ranked_spikes(spikes), SPIKE_COLS)


@query(
    """SELECT COUNT(*) AS total_spikes, COUNT(*) FILTER (severity = 'high') AS high_severity,
              (SELECT COUNT(*) FROM spikes) AS uncut_spikes
       FROM (SELECT * FROM spikes ORDER BY deviation DESC, date, state LIMIT 20)""",
    **SPIKE_CTES,
    spikes=SPIKES.format(level="state"),
)
def spike_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.spike_summary(anomaly.spike_detection(fixtures.updates(spark, sf_dir)))


@query(
    f"""SELECT district, growth FROM (
          SELECT district, {_growth('1', 7, 2)} AS growth FROM numbered GROUP BY district)
        WHERE abs(growth) > 10""",
    daily=f"SELECT date, district, {big(UPD, 'total')} FROM updates GROUP BY date, district",
    numbered=_numbered("daily", "district"),
)
def growth_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.growth_anomaly(fixtures.updates(spark, sf_dir), ["district"])


# --- statistics ----------------------------------------------------------------------------


def _describe(fact: str, m: str) -> str:
    return f"""
        SELECT '{m}' AS measure, ROUND(AVG({m}), 4) AS mean, ROUND(STDDEV_SAMP({m}), 4) AS std, MIN({m}) AS min,
               MAX({m}) AS max, quantile_cont({m}, 0.5) AS median, quantile_cont({m}, 0.25) AS q1,
               quantile_cont({m}, 0.75) AS q3 FROM {fact}"""


def _describe_all(fact: str, measures: list[str]) -> str:
    return " UNION ALL ".join(_describe(fact, m) for m in measures)


@query(_describe_all("updates", ["upd_new", "upd_old"]))
def describe_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe_measures(fixtures.updates(spark, sf_dir)), ["mean", "std"])


@query(_describe_all("renewals", ["ren_done", "ren_open"]))
def describe_measures_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.describe_measures(fixtures.renewals(spark, sf_dir)), ["mean", "std"])


def _corr(fact: str, a: str, b: str, digits: int = 6) -> str:
    value = f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"
    return f"SELECT '{a}' AS a, '{b}' AS b, ROUND({value}, {digits}) AS r FROM {fact}"


CORRELATION = " UNION ALL ".join(
    _corr("signups", a, b)
    for a in ("sgn_first", "sgn_act", "sgn_look")
    for b in ("sgn_first", "sgn_act", "sgn_look")
)


@query(CORRELATION)
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.correlation(fixtures.signups(spark, sf_dir)), ["r"], 6)


@query(
    " UNION ALL ".join(
        _corr("(SELECT CASE WHEN upd_old % 5 <> 0 THEN upd_new END AS upd_new, upd_old FROM updates)", a, b)
        for a in ("upd_new", "upd_old")
        for b in ("upd_new", "upd_old")
    )
)
def correlation_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of a pair missing: only rows with both values count."""
    fact = fixtures.updates(spark, sf_dir)
    gaps = fact.df.withColumn("upd_new", F.when(F.col("upd_old") % 5 != 0, F.col("upd_new")))
    return rounded(stats.correlation(Fact(gaps, fact.spec)), ["r"], 6)


@query(
    """
    SELECT 'describe' AS section, measure AS item, statistic, CAST(value AS DOUBLE) AS value FROM (
        UNPIVOT (SELECT measure, mean, std, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max, median, q1, q3
                 FROM described)
        ON mean, std, min, max, median, q1, q3 INTO NAME statistic VALUE value)
    UNION ALL SELECT 'correlation', a, b, r FROM correlated
    UNION ALL (SELECT 'distribution', state, 'records', CAST(COUNT(*) AS DOUBLE) FROM updates
               GROUP BY state ORDER BY COUNT(*) DESC, state LIMIT 10)""",
    described=_describe_all("updates", ["upd_new", "upd_old"]),
    correlated=" UNION ALL ".join(
        _corr("updates", a, b, 4) for a in ("upd_new", "upd_old") for b in ("upd_new", "upd_old")
    ),
)
def statistical_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.statistical_report(fixtures.updates(spark, sf_dir)), ["value"], 4)
