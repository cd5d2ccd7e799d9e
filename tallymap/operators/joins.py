"""Operators that bring the three fact tables together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import present, share, sum_or_zero, total
from tallymap.functions.shape import stack_facts
from tallymap.spec import Fact, FactSet


def entity_features(
    demographic: Fact, enrolment: Fact, grain: str = "district"
) -> DataFrame:
    """Measures of both tables per entity of the first one, zero where the second has none.

    One group-by over the stacked tables takes the place of aggregating each
    side and joining.  At district grain the distinct finest regions are counted too.
    """
    wide, middle, fine = demographic.spec.levels
    measures = [*demographic.spec.measures, *enrolment.spec.measures]
    known = f"{demographic.spec.name}_records"
    rows = stack_facts([demographic, enrolment], [wide, middle, fine])
    sums = [sum_or_zero(m).alias(m) for m in measures]
    finest = (
        present(rows, [wide, middle, *([fine] if grain == fine else [])])
        .groupBy(wide, middle, fine)
        .agg(*sums, F.sum(known).alias(known))
    )
    if grain == fine:
        return finest.filter(F.col(known) > 0).drop(known)
    places = F.count(F.when(F.col(known) > 0, F.col(fine))).alias("n_pincodes")
    entities = finest.groupBy(wide, middle).agg(*sums, places, F.sum(known).alias(known))
    return entities.filter(F.col(known) > 0).drop(known)


def dataset_totals(facts: FactSet, by: Sequence[str] = ()) -> DataFrame:
    """Totals of the three tables per region of the first one."""
    rows = present(stack_facts(facts.all(), by), by)
    names = ("demo_total", "bio_total", "enrol_total")
    known = f"{facts.demographic.spec.name}_records"
    totals = rows.groupBy(*by).agg(
        *[sum_or_zero(total(f.spec.measures)).alias(n) for f, n in zip(facts.all(), names)],
        F.sum(known).alias("known"),
    )
    return (totals.filter(F.col("known") > 0) if by else totals).drop("known")


def coverage_ratio(num: Fact, den: Fact, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Total of one table as a percentage of another's, 0 where the other has nothing."""
    rows = present(stack_facts([num, den], by), by)
    totals = rows.groupBy(*by).agg(
        sum_or_zero(total(num.spec.measures)).alias("num_total"),
        sum_or_zero(total(den.spec.measures)).alias("den_total"),
    )
    return totals.withColumn("pct", share(F.col("num_total"), F.col("den_total"), digits))


def concat_parts(parts: Sequence[Fact]) -> Fact:
    """Union of part tables with the same columns; duplicates stay."""
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return parts[0].on(df)
