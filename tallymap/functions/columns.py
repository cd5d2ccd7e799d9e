"""Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.spec import FactSpec


def total(measures: Sequence[str]) -> Column:
    """Row total; a missing measure counts as zero."""
    return reduce(add, [F.coalesce(F.col(m), F.lit(0)) for m in measures])


def with_total(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    return df.withColumn("total", total(measures))


def sum_or_zero(column: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(column), F.lit(0))


def measure_sums(spec: FactSpec) -> list[Column]:
    return [sum_or_zero(m).alias(m) for m in spec.measures]


def record_weight(spec: FactSpec) -> Column:
    """How many source rows one row stands for."""
    return F.col(spec.records_col) if spec.records_col else F.lit(1).cast("long")


def record_count(spec: FactSpec) -> Column:
    return sum_or_zero(record_weight(spec)) if spec.records_col else F.count(F.lit(1))


def present(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Drop rows with a missing grouping key."""
    conditions = [F.col(k).isNotNull() for k in keys]
    return df.filter(reduce(and_, conditions)) if conditions else df


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0 or missing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(ratio(part, whole) * 100, digits)


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent, 0 unless the old value is positive."""
    return F.when(old > 0, (new - old) / F.nullif(old, F.lit(0)) * 100).otherwise(F.lit(0.0))


def calendar_cols(date: str | Column) -> dict[str, Column]:
    """Calendar features; Monday is day 0 of the week."""
    return {
        "day_of_year": F.dayofyear(date),
        "month": F.month(date),
        "day_of_week": F.weekday(date),
    }


def iso(date: str | Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def trunc_long(value: Column) -> Column:
    """Whole part, towards zero."""
    return value.cast("bigint")


def per_day(amount: Column, days: Column) -> Column:
    """Daily average as a whole number; at least one day is assumed."""
    return trunc_long(amount / F.greatest(days, F.lit(1)))


def ceil_div(amount: Column, unit: int) -> Column:
    return F.ceil(amount / F.lit(unit)).cast("bigint")
