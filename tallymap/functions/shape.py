"""Putting aggregated frames next to each other without joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import measure_sums, record_weight, sum_or_zero
from tallymap.spec import Fact, FactSet


def align(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Full outer alignment of frames holding at most one row per key.

    The frames are stacked and folded with one aggregation, so any number of
    them costs a single shuffle of already aggregated rows (one row each when
    there are no keys) and no join order has to be chosen.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def stack_facts(facts: Sequence[Fact], keys: Sequence[str]) -> DataFrame:
    """Union of several fact tables on common keys.

    Each table keeps its own measure columns (NULL on the rows of the others)
    and adds ``<name>_records``, so one group-by answers for all tables at once.
    """
    parts = [
        f.df.select(*keys, *f.spec.measures, record_weight(f.spec).alias(f"{f.spec.name}_records"))
        for f in facts
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def fold_places(facts: FactSet, *extra: Column) -> DataFrame:
    """One row per finest region with the sums and record counts of all tables.

    One scan of every table; what follows (totals per region, distinct regions,
    dates) works on places.  ``is_place`` marks regions the first table knows.
    ``extra`` are further aggregates over the stacked rows.
    """
    levels = facts.demographic.spec.levels
    date = facts.demographic.spec.date_col
    first = f"{facts.demographic.spec.name}_records"
    return stack_facts(facts.all(), [date, *levels]).groupBy(*levels).agg(
        *[c for f in facts.all() for c in measure_sums(f.spec)],
        *[sum_or_zero(n).alias(n) for n in (f"{f.spec.name}_records" for f in facts.all())],
        (F.count(first) > 0).alias("is_place"),
        *extra,
    )


def distinct_places(levels: Sequence[str]) -> list[Column]:
    """Distinct regions of each level the first table knows."""
    return [F.count_distinct(F.when(F.col("is_place"), F.col(c))).alias(f"{c}s") for c in levels]
