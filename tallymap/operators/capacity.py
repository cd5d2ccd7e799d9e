"""Capacity, staffing and cost per region, as column arithmetic on aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import ceil_div, per_day, present, sum_or_zero, total
from tallymap.functions.shape import align, stack_facts
from tallymap.operators.rollup import rollup_by
from tallymap.operators.trends import growth_rate_7
from tallymap.spec import CostParams, Fact, FactSet

DEFAULT = CostParams()


def daily_loads(fact: Fact, by: Sequence[str]) -> DataFrame:
    """Totals per region and day, rows without a date kept as a day of their own."""
    amount = sum_or_zero(total(fact.spec.measures)).alias("total")
    return present(fact.df, by).groupBy(*by, fact.spec.date_col).agg(amount)


def load_columns(date: str = "date", amount: str = "total") -> list[Column]:
    """Daily average and peak; rows without a date count for the average's total only."""
    dated = F.when(F.col(date).isNotNull(), F.col(amount))
    return [
        per_day(F.sum(amount), F.count(date)).alias("avg_daily"),
        F.coalesce(F.max(dated), F.lit(0)).alias("peak"),
    ]


def utilization(avg_daily: Column, peak: Column) -> Column:
    """Average load in percent of the peak, 0 when either is 0."""
    both = (avg_daily != 0) & (peak != 0)
    value = F.round(avg_daily / F.nullif(peak, F.lit(0)) * 100, 1)
    return F.when(both, value).otherwise(F.lit(0.0))


def capacity_utilization(fact: Fact, by: Sequence[str] = ("state",)) -> DataFrame:
    date = fact.spec.date_col
    load = daily_loads(fact, by).groupBy(*by).agg(*load_columns(date))
    rated = load.withColumn("capacity", utilization(F.col("avg_daily"), F.col("peak")))
    return rated.withColumn("efficient", F.col("capacity") > 70)


def monthly_cost(avg_daily: Column, p: CostParams = DEFAULT) -> Column:
    return ceil_div(avg_daily, p.per_staff_per_day) * p.staff_monthly + p.fixed_monthly


def cost_model(capacity_df: DataFrame, params: CostParams = DEFAULT) -> DataFrame:
    """Staff, monthly and annual cost, cost per item, productivity and revenue."""
    avg, peak, p = F.col("avg_daily"), F.col("peak"), params
    staffed = capacity_df.withColumns(
        {
            "staff": ceil_div(avg, p.per_staff_per_day),
            "peak_staff": ceil_div(peak, p.per_staff_per_day),
        }
    ).withColumns(
        {
            "staff_cost": F.col("staff") * p.staff_monthly,
            "monthly": monthly_cost(avg, p),
        }
    )
    per_item = F.round(F.col("monthly") / F.nullif(avg * p.days_per_month, F.lit(0)), 2)
    per_staff = F.round(avg / F.nullif("staff", F.lit(0)), 0)
    return staffed.withColumns(
        {
            "annual": F.col("monthly") * 12,
            "cost_per_enrollment": F.when(avg > 0, per_item).otherwise(F.lit(0.0)),
            "productivity": F.when(avg > 0, per_staff).otherwise(F.lit(0.0)),
            "revenue": avg * p.days_per_month * p.revenue_per_item,
        }
    )


def _flag(condition: Column, code: str) -> Column:
    return F.when(condition, F.lit(code))


def cost_advice(costs: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """One row per region and flag that applies."""
    c = F.col
    peaky = c("peak_staff") > c("staff") * 1.5
    flags = F.array(
        _flag(c("cost_per_enrollment") > 200, "cost_high"),
        _flag(c("staff_cost") / c("monthly") > 0.6, "staff_share_high"),
        F.when(peaky, "peak_demand").otherwise("staff_balanced"),
        _flag(c("cost_per_enrollment") < 150, "cost_optimal"),
        _flag(c("avg_daily") < 1000, "volume_low"),
        _flag(c("avg_daily") > 10000, "volume_high"),
    )
    return costs.select(*by, F.explode(F.array_compact(flags)).alias("flag"))


def capacity_advice(
    load_fact: Fact, growth_fact: Fact, by: Sequence[str] = ("state",)
) -> DataFrame:
    """Under-use, strain and trend change per region; thresholds apply to unrounded capacity."""
    date = load_fact.spec.date_col
    load = daily_loads(load_fact, by).groupBy(*by).agg(*load_columns(date))
    peak = F.coalesce(F.nullif("peak", F.lit(0)), F.lit(1))
    used = load.select(*by, (F.col("avg_daily") / peak * 100).alias("used"))
    growth = growth_rate_7(rollup_by(growth_fact, [growth_fact.spec.date_col, *by]), by, date)
    both = align([used, growth.withColumn("growth", F.round("growth", 2))], by).filter(
        F.col("used").isNotNull()
    )

    def advice(condition: Column, priority: str, code: str) -> Column:
        return F.when(condition, F.struct(F.lit(priority).alias("priority"), F.lit(code).alias("code")))

    rules = F.array(
        advice(F.col("used") < 60, "Medium", "underused"),
        advice(F.col("used") > 85, "High", "strained"),
        advice(F.abs("growth") > 10, "Medium", "trend_change"),
    )
    return both.select(*by, F.inline(F.array_compact(rules)))


def resource_plan(
    capacity_df: DataFrame, by: Sequence[str] = ("state",), params: CostParams = DEFAULT
) -> DataFrame:
    peak = F.coalesce(F.nullif("peak", F.lit(0)), F.lit(1))
    return capacity_df.select(
        *by,
        ceil_div(F.col("avg_daily"), params.per_center_per_day).alias("centers"),
        ceil_div(peak, params.per_center_per_day).alias("peak_centers"),
        F.round(peak * params.saving_rate, 1).alias("savings"),
    )


def coverage_summary(facts: FactSet, by: Sequence[str] = ("state",)) -> DataFrame:
    """First table against the third and second against first, in percent (NULL without a base)."""
    known = f"{facts.demographic.spec.name}_records"
    totals = stack_facts(facts.all(), by).groupBy(*by).agg(
        *[
            sum_or_zero(total(f.spec.measures)).alias(n)
            for f, n in zip(facts.all(), ("demo", "bio", "enrol"))
        ],
        F.sum(known).alias("known"),
    )
    kept = totals.filter(F.col("known") > 0)
    for key in by:
        kept = kept.filter(F.col(key).isNotNull())

    def percent(a: str, b: str) -> Column:
        return F.round(F.col(a) / F.nullif(b, F.lit(0)) * 100, 1)

    return kept.select(
        *by,
        percent("demo", "enrol").alias("demo_vs_enrol_pct"),
        percent("bio", "demo").alias("bio_vs_demo_pct"),
    )
