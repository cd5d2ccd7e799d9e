"""Data-quality report of a fact table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import present, record_weight, sum_or_zero, total
from tallymap.operators.anomaly import zscores
from tallymap.spec import Fact


def _rows(df: DataFrame, checks: Sequence[tuple[str, str, Column]], whole: Column) -> DataFrame:
    """One pass over the frame, one row per check."""
    counted = df.agg(
        whole.alias("total"), *[n.alias(f"c{i}") for i, (_, _, n) in enumerate(checks)]
    )
    cells = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(column).alias("column"),
            F.col(f"c{i}").alias("failed"),
            F.col("total"),
        )
        for i, (check, column, _) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*cells)))


def quality_report(
    fact: Fact, date_min: date, date_max: date, others: Sequence[Fact] = ()
) -> DataFrame:
    """Failed and checked rows per check.

    Missing values and ranges count source rows, outliers count days beyond two
    and three deviations, consistency counts regions absent from another table.
    """
    spec = fact.spec
    wide, day = spec.levels[0], F.col(spec.date_col)
    weight = record_weight(spec)

    def bad(condition: Column) -> Column:
        return sum_or_zero(F.when(condition, weight))

    columns = [spec.date_col, *spec.levels, *spec.measures]
    outside = (day < F.lit(date_min)) | (day > F.lit(date_max))
    failures = [("missing", c, bad(F.col(c).isNull())) for c in columns]
    failures.append(("date_range", spec.date_col, bad(outside)))
    failures += [("negative", m, bad(F.col(m) < 0)) for m in spec.measures]
    # All checks read this fold by day and region.  Missing keys stay in: they are counted, and
    # a filter on a key would be pushed below the fold and keep it from being shared.
    folded = fact.df.groupBy(spec.date_col, wide).agg(
        sum_or_zero(weight).alias("rows"),
        sum_or_zero(total(spec.measures)).alias("total"),
        *[n.alias(f"f{i}") for i, (_, _, n) in enumerate(failures)],
    )
    checks = [(check, c, sum_or_zero(f"f{i}")) for i, (check, c, _) in enumerate(failures)]
    parts = [_rows(folded, checks, sum_or_zero("rows"))]

    daily = folded.groupBy(spec.date_col).agg(F.sum("total").alias("total"))
    z = F.abs("z_score")
    outliers = [(f"outlier_{n}sd", "total", F.count_if(z > n)) for n in (2, 3)]
    parts.append(_rows(zscores(daily, spec.date_col), outliers, F.count(spec.date_col)))

    regions = folded.groupBy(wide).agg(F.sum("rows").alias("rows"))
    for other in others:
        known = present(other.df, [wide]).select(F.col(wide).alias("known")).distinct()
        matched = regions.join(known, F.col(wide) == F.col("known"), "left")
        absent = F.count_if(F.col(wide).isNotNull() & F.col("known").isNull())
        parts.append(_rows(matched, [(f"absent_in_{other.spec.name}", wide, absent)], F.count(wide)))

    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    passed = 1 - F.col("failed") / F.nullif("total", F.lit(0))
    return report.withColumn("pass_rate", F.round(passed, 4))


def quality_score(report: DataFrame) -> DataFrame:
    """Share of passed checks over all checked rows."""
    return report.agg(
        F.round(1 - F.sum("failed") / F.nullif(F.sum("total"), F.lit(0)), 6).alias("score")
    )
