"""Time-series operators on daily series.

A series holds one row per date that occurs (gaps are not filled) and, with
``by``, per region.  Frames count rows, not calendar days.  A series is already
aggregated, so a window partition holds at most one row per date, whatever the
size of the fact table or the share of its largest region.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymap.functions.columns import percent_change, present, record_count
from tallymap.operators.rollup import daily_totals, rollup_by
from tallymap.spec import Fact, FactSet


def _by_date(by: Sequence[str], date: str):
    return W.partitionBy(*by).orderBy(date)


def moving_averages(
    series: DataFrame, windows: Sequence[int] = (7, 30), by: Sequence[str] = (), date: str = "date"
) -> DataFrame:
    """Trailing means over n rows including the current one."""
    order = _by_date(by, date)
    means = {f"avg_{n}": F.avg("total").over(order.rowsBetween(1 - n, 0)) for n in windows}
    return series.withColumns(means)


def rolling_stats(
    series: DataFrame,
    by: Sequence[str] = ("state",),
    window: int = 7,
    baseline: str = "trailing",
    date: str = "date",
) -> DataFrame:
    """Mean and sample deviation of the last ``window`` rows.

    ``trailing`` includes the current row, ``prior`` ends just before it.
    """
    first, last = {"trailing": (1 - window, 0), "prior": (-window, -1)}[baseline]
    frame = _by_date(by, date).rowsBetween(first, last)
    return series.withColumns(
        {
            "rolling_avg": F.avg("total").over(frame),
            "rolling_std": F.stddev_samp("total").over(frame),
        }
    )


def numbered(series: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Row number by date and length of each series; rows without a date come last and are not counted."""
    part = W.partitionBy(*by)
    return series.withColumns(
        {
            "rn": F.row_number().over(part.orderBy(F.col(date).asc_nulls_last())),
            "n": F.count(date).over(part),
        }
    )


def _recent(value: str, n: int = 7) -> Column:
    """Mean of the last n dated rows."""
    return F.avg(F.when((F.col("rn") > F.col("n") - n) & (F.col("rn") <= F.col("n")), F.col(value)))


def _from_row(value: str, start: Column, n: int = 7) -> Column:
    """Mean of n rows from the given row number on."""
    inside = F.col("rn").between(start, start + (n - 1)) & (F.col("rn") <= F.col("n"))
    return F.avg(F.when(inside, F.col(value)))


def growth_7() -> Column:
    """Last 7 against first 7 rows of a numbered series, 0 for series of 7 rows or fewer."""
    change = percent_change(_recent("total"), _from_row("total", F.lit(1)))
    return F.when(F.max("n") > 7, change).otherwise(F.lit(0.0))


def growth_rate_7(series: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    return numbered(series, by, date).groupBy(*by).agg(growth_7().alias("growth"))


def growth_30() -> Column:
    """Last 7 rows against the first 7 of the last 37, 0 for series of 30 rows or fewer."""
    change = percent_change(_recent("total"), _from_row("total", F.greatest(F.lit(1), F.col("n") - 36)))
    return F.when(F.max("n") > 30, change).otherwise(F.lit(0.0))


def growth_rate_30(series: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    return numbered(series, by, date).groupBy(*by).agg(growth_30().alias("growth"))


def direction(value: str) -> Column:
    """Last 7 against first 7 rows of a numbered series in words."""
    recent, older = _recent(value), _from_row(value, F.lit(1))
    return (
        F.when(F.max("n") <= 1, "stable")
        .when(recent > older, "increasing")
        .when(recent < older, "decreasing")
        .otherwise("stable")
    )


def trend_label(
    counts: DataFrame, by: Sequence[str] = (), value: str = "n_records", date: str = "date"
) -> DataFrame:
    """Direction of the daily record counts."""
    return numbered(counts, by, date).groupBy(*by).agg(direction(value).alias("trend"))


def peak_columns(date: str = "date", value: str = "total") -> list[Column]:
    """Largest and smallest day; the earliest date wins a tie."""
    early = F.struct(F.col(value), -F.unix_date(date))
    late = F.struct(F.col(value), F.unix_date(date))
    return [
        F.max_by(date, early).alias("peak_date"),
        F.max(value).alias("peak"),
        F.min_by(date, late).alias("low_date"),
        F.min(value).alias("low"),
    ]


def peak_low(series: DataFrame, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    return series.groupBy(*by).agg(*peak_columns(date))


def trend_report(fact: Fact, by: Sequence[str] = (), min_days: int = 7) -> DataFrame:
    """Growth, peak, low, mean and deviation of daily totals; short series give no row."""
    date = fact.spec.date_col
    series = numbered(rollup_by(fact, [date, *by]), by, date)
    report = series.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("total").alias("average"),
        F.stddev_samp("total").alias("volatility"),
        *peak_columns(date),
        growth_30().alias("growth"),
    )
    return report.filter(F.col("n_days") >= min_days)


def time_series_panel(facts: FactSet) -> DataFrame:
    """Daily totals of the first and the third table, one row per table and date."""
    demo, enrol = facts.demographic, facts.enrolment
    parts = [daily_totals(f).withColumn("dataset", F.lit(f.spec.name)) for f in (demo, enrol)]
    panel = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return panel.select("dataset", demo.spec.date_col, *demo.spec.measures, *enrol.spec.measures, "total")


def record_series(fact: Fact, by: Sequence[str] = ()) -> DataFrame:
    """Rows per date (and region) in the form :func:`trend_label` reads."""
    keys = [fact.spec.date_col, *by]
    return present(fact.df, keys).groupBy(*keys).agg(record_count(fact.spec).alias("n_records"))
