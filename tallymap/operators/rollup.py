"""Group-by operators over the date and geography columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import (
    calendar_cols,
    measure_sums,
    present,
    record_count,
    share,
    sum_or_zero,
    total,
    with_total,
)
from tallymap.functions.name_tables import ALIASES, INVALID_NAMES
from tallymap.functions.names import Aliases, normalize_region_name
from tallymap.functions.shape import distinct_places, fold_places
from tallymap.operators.filters import filter_region
from tallymap.operators.topk import top_k
from tallymap.spec import Fact, FactSet


def daily_cube(fact: Fact) -> Fact:
    """One row per date and finest region: sums plus the number of source rows.

    Every operator but the per-record statistics gives the same answer on the
    cube as on the raw table, so write it once and query that.
    """
    keys = [fact.spec.date_col, *fact.spec.levels]
    df = fact.df.groupBy(*keys).agg(*measure_sums(fact.spec), record_count(fact.spec).alias("records"))
    return Fact(df, replace(fact.spec, records_col="records"))


def rollup_by(fact: Fact, keys: Sequence[str]) -> DataFrame:
    sums = present(fact.df, keys).groupBy(*keys).agg(*measure_sums(fact.spec))
    return with_total(sums, fact.spec.measures)


def rollup_named(
    fact: Fact,
    keys: Sequence[str],
    aliases: Aliases = ALIASES,
    invalid: Iterable[str] = INVALID_NAMES,
    strict: bool = False,
) -> DataFrame:
    """``rollup_by`` on a table whose names of the widest level are still as they were written.

    Rows are summed by the written names, the names are cleaned on those sums, and what has become one
    region is summed again: the rules run once per distinct key, not per row.
    """
    wide = fact.spec.levels[0]
    if wide not in keys:
        return rollup_by(fact, keys)
    rest = [k for k in keys if k != wide]
    raw = present(fact.df, rest).groupBy(*keys).agg(*measure_sums(fact.spec))
    return rollup_by(fact.on(normalize_region_name(raw, wide, aliases, invalid, strict)), keys)


def daily_totals(fact: Fact) -> DataFrame:
    return rollup_by(fact, [fact.spec.date_col])


def levels_of(level: str | Sequence[str]) -> list[str]:
    """One level or several that name a region together, as (state, district): names of districts may repeat."""
    return [level] if isinstance(level, str) else list(level)


def daily_by_region(fact: Fact, level: str | Sequence[str] = "state") -> DataFrame:
    return rollup_by(fact, [fact.spec.date_col, *levels_of(level)])


def _ranked(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("total"), F.asc(key))


def drill_down(fact: Fact, state: str | None = None, district: str | None = None) -> DataFrame:
    """Next level of the hierarchy below the selected region, largest first.

    Without a state the answer is by state, whatever the district says.
    """
    wide, middle, fine = fact.spec.levels
    level = wide if not state else middle if not district else fine
    scope = filter_region(fact, state, district if state else None)
    sums = rollup_by(scope, [level])
    named = sums.select(
        F.lit(level).alias("level"),
        F.col(level).cast("string").alias("key"),
        *scope.spec.measures,
        "total",
    )
    return _ranked(named, "key")


def drill_down_all(fact: Fact) -> DataFrame:
    """Every level of the hierarchy in one job.

    Raw rows are summed at the finest grain first, so the rollup multiplies
    aggregated rows only.
    """
    levels = list(fact.spec.levels)
    finest = fact.df.groupBy(*levels).agg(*measure_sums(fact.spec))
    sums = finest.rollup(*levels).agg(F.grouping_id().alias("gid"), *measure_sums(fact.spec))
    # grouping_id has one bit per column, set where the column is rolled up.
    depth = F.lit(len(levels)) - F.bit_count("gid")
    kept = F.lit(False)
    for n in range(1, len(levels) + 1):
        known = F.lit(True)
        for c in levels[:n]:
            known = known & F.col(c).isNotNull()
        kept = kept | ((depth == n) & known)
    name = F.element_at(F.array(*[F.lit(c) for c in levels]), depth.cast("int"))
    return with_total(sums.filter(kept).withColumn("level", name), fact.spec.measures).select(
        "level", *levels, *fact.spec.measures, "total"
    )


def heatmap(fact: Fact, k: int = 50) -> DataFrame:
    keys = list(fact.spec.levels[:2])
    return top_k(rollup_by(fact, keys), "total", k, keys)


def coverage(fact: Fact, by: Sequence[str] = ()) -> DataFrame:
    """Distinct regions of every level.  Distinct places are formed first, so the
    several distinct counts work on places, not on rows."""
    levels = fact.spec.levels
    places = present(fact.df, by).select(*levels).distinct()
    return places.groupBy(*by).agg(*[F.count_distinct(c).alias(f"{c}s") for c in levels])


def age_distribution(fact: Fact, by: Sequence[str] = ()) -> DataFrame:
    measures = fact.spec.measures
    sums = present(fact.df, by).groupBy(*by).agg(*measure_sums(fact.spec))
    whole = total(measures)
    return sums.select(
        *by, *measures, *[share(F.col(m), whole).alias(f"{m}_percent") for m in measures]
    )


def pincode_features(fact: Fact) -> DataFrame:
    """Sums per finest region with the names above it (smallest name when they differ:
    a distributed table has no first row)."""
    *above, fine = fact.spec.levels
    return present(fact.df, [fine]).groupBy(fine).agg(
        *measure_sums(fact.spec), *[F.min(c).alias(c) for c in above]
    )


def daily_record_counts(fact: Fact) -> DataFrame:
    date = fact.spec.date_col
    return present(fact.df, [date]).groupBy(date).agg(record_count(fact.spec).alias("n"))


def region_record_counts(fact: Fact, level: str = "state", k: int = 10) -> DataFrame:
    counts = present(fact.df, [level]).groupBy(level).agg(record_count(fact.spec).alias("n"))
    return top_k(counts, "n", k, [level])


def calendar_totals(fact: Fact) -> DataFrame:
    """Totals by day of year, month and weekday; years fall together where all three agree."""
    spec = fact.spec
    daily = present(fact.df, [spec.date_col]).groupBy(spec.date_col).agg(
        sum_or_zero(total(spec.measures)).alias("total")
    )
    features = calendar_cols(spec.date_col)
    return daily.groupBy(*[c.alias(n) for n, c in features.items()]).agg(F.sum("total").alias("total"))


def time_rollup(fact: Fact, unit: str) -> DataFrame:
    """Totals per calendar unit (``week`` starts on Monday, ``month``, ...)."""
    spec = fact.spec
    period = F.trunc(spec.date_col, unit).alias("period")
    sums = present(fact.df, [spec.date_col]).groupBy(period).agg(*measure_sums(spec))
    return with_total(sums, spec.measures)


def overview(facts: FactSet) -> DataFrame:
    """One row: record counts and band sums of the three tables, coverage and dates of the first."""
    spec = facts.demographic.spec
    dated = F.when(F.col(f"{spec.name}_records").isNotNull(), F.col(spec.date_col))
    places = fold_places(facts, F.min(dated).alias("start_date"), F.max(dated).alias("end_date"))
    counts = [f"{f.spec.name}_records" for f in facts.all()]
    return places.agg(
        *[sum_or_zero(c).alias(c) for c in counts],
        *[c for f in facts.all() for c in measure_sums(f.spec)],
        F.min("start_date").alias("start_date"),
        F.max("end_date").alias("end_date"),
        *distinct_places(spec.levels),
    )
