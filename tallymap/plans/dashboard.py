"""Country dashboard and the report per region."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import present, sum_or_zero, total
from tallymap.functions.shape import distinct_places, fold_places, stack_facts
from tallymap.operators.anomaly import low_activity_alerts
from tallymap.operators.capacity import load_columns, monthly_cost, utilization
from tallymap.operators.filters import last_date
from tallymap.operators.rollup import levels_of, rollup_by
from tallymap.operators.topk import top_bottom
from tallymap.spec import FactSet


def kpi_dashboard(facts: FactSet, n_expected: int = 36, days: int = 30) -> DataFrame:
    """Record counts, coverage and recent records (second table not counted there)."""
    demo, _, enrol = facts.all()
    wide = demo.spec.levels[0]
    since = F.date_sub(last_date(demo), days)
    counted = [f"{f.spec.name}_records" for f in (demo, enrol)]
    weight = reduce(add, [F.coalesce(c, F.lit(0)) for c in counted])
    recent = sum_or_zero(F.when(F.col(demo.spec.date_col) >= since, weight))
    every = reduce(add, [F.sum(f"{f.spec.name}_records") for f in facts.all()])
    row = fold_places(facts, recent.alias("recent")).agg(
        every.alias("total_records"),
        *distinct_places(demo.spec.levels),
        sum_or_zero("recent").alias(f"recent_{days}_days"),
    )
    return row.withColumn("coverage_percentage", F.col(f"{wide}s") / n_expected * 100)


def dashboard(facts: FactSet) -> dict[str, DataFrame]:
    demo = facts.demographic
    wide = demo.spec.levels[0]
    totals = rollup_by(demo, [wide])
    return {
        "kpis": kpi_dashboard(facts),
        "performers": top_bottom(totals, [wide]),
        "alerts": low_activity_alerts(demo, wide),
    }


def region_report(facts: FactSet, level: str | Sequence[str] | None = "state") -> DataFrame:
    """Enrolment load, capacity, cost and band sums of the other two tables, one row per region;
    ``level=None`` gives one row for the country.

    Several levels, as (state, district), name a region together; level and name are then joined by a slash.
    """
    by = levels_of(level) if level else []
    demo, bio, enrol = facts.all()
    date = enrol.spec.date_col
    bands = [*demo.spec.measures[:2], *bio.spec.measures[:2]]
    # Days of all tables in one pass; the load is that of the third table's days.
    rows = present(stack_facts(facts.all(), [*by, date]), by)
    days = rows.groupBy(*by, date).agg(
        sum_or_zero(total(enrol.spec.measures)).alias("amount"),
        F.count(f"{enrol.spec.name}_records").alias("seen"),
        *[sum_or_zero(m).alias(m) for m in bands],
    )
    days = days.withColumn("day", F.when(F.col("seen") > 0, F.col(date)))
    both = days.groupBy(*by).agg(
        F.sum("amount").alias("total_enrollments"),
        *load_columns("day", "amount"),
        *[F.sum(m).alias(m) for m in bands],
    )
    avg, peak = F.col("avg_daily"), F.col("peak")
    return both.select(
        F.lit("/".join(by) or "country").alias("level"),
        (F.concat_ws("/", *[F.col(c).cast("string") for c in by]) if by else F.lit("all")).alias("name"),
        "total_enrollments",
        "avg_daily",
        "peak",
        utilization(avg, peak).alias("capacity_pct"),
        *bands,
        monthly_cost(avg).alias("monthly_cost"),
    )
