"""Anomaly operators on daily totals and region totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymap.operators.rollup import daily_by_region, daily_totals, levels_of, rollup_by
from tallymap.operators.topk import top_k
from tallymap.operators.trends import growth_rate_7, rolling_stats
from tallymap.spec import Fact


def zscores(daily: DataFrame, date: str = "date") -> DataFrame:
    """Daily totals with mean, sample deviation and z-score over all days."""
    everything = W.partitionBy()  # one row per day is left here
    dated = F.when(F.col(date).isNotNull(), F.col("total"))
    scored = daily.withColumns(
        {"mean": F.avg(dated).over(everything), "std": F.stddev_samp(dated).over(everything)}
    )
    return scored.withColumn("z_score", (dated - F.col("mean")) / F.nullif("std", F.lit(0)))


def zscore_anomalies(fact: Fact, threshold: float = 2.0) -> DataFrame:
    scored = zscores(daily_totals(fact), fact.spec.date_col)
    return scored.filter(F.abs("z_score") > threshold)


def spike_detection(
    fact: Fact,
    level: str | Sequence[str] = "state",
    window: int = 7,
    min_days: int = 7,
    baseline: str = "trailing",
) -> DataFrame:
    """Days on which a region exceeds its rolling mean by two deviations; several levels name a region together.

    With the ``trailing`` baseline the day itself is part of the window, which
    bounds its z-score by (n-1)/sqrt(n) and rules out severity ``high`` at
    window 7; ``prior`` compares with the days before.
    """
    date = fact.spec.date_col
    by = levels_of(level)
    series = rolling_stats(daily_by_region(fact, by), by, window, baseline, date)
    days = F.count(F.lit(1)).over(W.partitionBy(*by))
    value, avg, std = F.col("total"), F.col("rolling_avg"), F.col("rolling_std")
    spikes = series.withColumn("days", days).filter(
        (F.col("days") >= min_days) & (value > avg + 2 * std)
    )
    return spikes.select(
        date,
        *by,
        value.alias("value"),
        "rolling_avg",
        "rolling_std",
        ((value - avg) / F.nullif(avg, F.lit(0)) * 100).alias("deviation"),
        F.when(value > avg + 3 * std, "high").otherwise("medium").alias("severity"),
    )


def ranked_spikes(spikes: DataFrame, k: int = 20, keys: Sequence[str] = ("date", "state")) -> DataFrame:
    return top_k(spikes, "deviation", k, keys)


def spike_summary(spikes: DataFrame, k: int = 20, keys: Sequence[str] = ("date", "state")) -> DataFrame:
    """Counts over the k largest spikes, with the count before the cut next to them."""
    cut = ranked_spikes(spikes, k, keys).agg(
        F.count(F.lit(1)).alias("total_spikes"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
    )
    everything = spikes.agg(F.count(F.lit(1)).alias("uncut_spikes"))
    return cut.withColumn("uncut_spikes", everything.scalar())


def low_activity_alerts(
    fact: Fact, level: str = "state", frac: float = 0.3, k: int | None = 10
) -> DataFrame:
    """Regions below a fraction of the mean region total, largest first; ``k=None`` lists all."""
    totals = rollup_by(fact, [level]).select(level, "total")
    mean = totals.select(F.avg("total")).scalar()
    low = totals.filter(F.col("total") < mean * frac).withColumns(
        {"type": F.lit("low_activity"), "severity": F.lit("medium")}
    )
    return low if k is None else top_k(low, "total", k, [level])


def growth_anomaly(fact: Fact, by: Sequence[str] = ("state",), limit: float = 10.0) -> DataFrame:
    """Regions whose growth between first and last week exceeds the limit either way."""
    growth = growth_rate_7(rollup_by(fact, [fact.spec.date_col, *by]), by, fact.spec.date_col)
    rounded = growth.withColumn("growth", F.round("growth", 2))
    return rounded.filter(F.abs("growth") > limit)
