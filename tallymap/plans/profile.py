"""Region profiles and comparisons: several aggregates put side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import (
    measure_sums,
    per_day,
    present,
    record_count,
    share,
    sum_or_zero,
    total,
)
from tallymap.functions.shape import align, stack_facts
from tallymap.operators.filters import entity_values, filter_entities
from tallymap.operators.rollup import coverage, levels_of, rollup_by
from tallymap.operators.topk import top_k
from tallymap.operators.trends import direction, growth_7, numbered, peak_columns
from tallymap.spec import Fact, FactSet


def profile(fact: Fact, base: Fact | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Everything about a table (or each of its regions) in one row.

    Two passes over the facts, which read different columns: one folds dates
    and measures to days, from which counts, sums, growth and peak follow; one
    folds the geography columns to places for the coverage.
    ``base`` adds the rate against another table's total.
    """
    spec, date = fact.spec, fact.spec.date_col
    daily = present(fact.df, by).groupBy(*by, date).agg(
        *measure_sums(spec), record_count(spec).alias("records")
    )
    daily = daily.withColumn("total", total(spec.measures))
    whole = F.sum("total")
    dated = F.when(F.col(date).isNotNull(), F.col("total"))
    summary = numbered(daily, by, date).withColumn("dated", dated).groupBy(*by).agg(
        F.sum("records").alias("records"),
        whole.alias("total"),
        *[F.sum(m).alias(m) for m in spec.measures],
        *[share(F.sum(m), whole).alias(f"{m}_percent") for m in spec.measures],
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.round(growth_7(), 2).alias("growth_7"),
        per_day(whole, F.count(date)).alias("avg_daily"),
        *peak_columns(date, "dated")[:2],
    )
    frames = [summary, coverage(fact, by)]
    if base is not None:
        base_total = sum_or_zero(total(base.spec.measures)).alias("base_total")
        frames.append(present(base.df, by).groupBy(*by).agg(base_total))
    out = align(frames, by).filter(F.col("records") > 0)
    if base is None:
        return out
    return out.withColumn("rate", share(F.col("total"), F.col("base_total"))).drop("base_total")


def profile_by(fact: Fact, level: str = "state", base: Fact | None = None) -> DataFrame:
    return profile(fact, base, [level])


def top_performers(fact: Fact, keys: Sequence[str] = ("state",), k: int = 10) -> DataFrame:
    return top_k(rollup_by(fact, keys), "total", k, keys)


def compare_entities(facts: FactSet, level: str | Sequence[str], entities: Sequence) -> DataFrame:
    """Totals, daily average, direction, coverage and rates of the requested regions.

    All entities are answered by one filter and group-by per aspect.  Rows come
    in request order with repeats; entities the first table lacks are left out.  With several
    levels, as (state, district), an entity is a tuple of names; districts of one name stay apart.
    """
    demo = facts.demographic
    wide, middle, fine = demo.spec.levels
    date = demo.spec.date_col
    by = levels_of(level)
    parts = [(e,) if isinstance(level, str) else tuple(e) for e in entities]
    scoped = facts.map(lambda f: _filtered(f, by, parts))
    known = F.col(f"{demo.spec.name}_records")
    # Days of all tables in one pass; only days of the first one count as days.
    days = stack_facts(scoped.all(), [*by, date]).groupBy(*by, date).agg(
        *[
            sum_or_zero(total(f.spec.measures)).alias(n)
            for f, n in zip(scoped.all(), ("total_demographic", "total_biometric", "total_enrollment"))
        ],
        F.sum(known).alias("n_records"),
    )
    days = numbered(days.withColumn("day", F.when(F.col("n_records") > 0, F.col(date))), by, "day")
    totals = days.groupBy(*by).agg(
        *[F.sum(n).alias(n) for n in ("total_demographic", "total_biometric", "total_enrollment")],
        F.sum("n_records").alias("known"),
        F.count("day").alias("days"),
        direction("n_records").alias("trend"),
    )
    places = coverage(scoped.demographic, by).select(
        *by, F.col(f"{middle}s").alias("districts"), F.col(f"{fine}s").alias("pincodes")
    )
    answers = align([totals, places], by)
    demo_total = F.col("total_demographic")
    keys = [f"key{i}" for i in range(len(by))]
    values = zip(*(entity_values(demo, c, [p[i] for p in parts]) for i, c in enumerate(by)), strict=True)
    request = demo.df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.struct(*[v.alias(k) for v, k in zip(row, keys)], F.lit("/".join(map(str, p))).alias("entity"))
                               for row, p in zip(values, parts)]))
        .alias("ord", "wanted")
    )
    same = reduce(and_, [F.col(k) == F.col(c) for k, c in zip(keys, by)])
    found = request.select("ord", "wanted.*").join(answers.filter(F.col("known") > 0), same)
    return found.select(
        "ord",
        "entity",
        "total_demographic",
        "total_biometric",
        "total_enrollment",
        per_day(demo_total, F.col("days")).alias("avg_daily"),
        "trend",
        F.when(F.lit(by == [wide]), F.col("districts")).alias("districts"),
        "pincodes",
        share(F.col("total_biometric"), demo_total, 1).alias("bio_coverage_percent"),
        share(F.col("total_enrollment"), demo_total, 1).alias("enrollment_rate"),
    ).orderBy("ord")


def _filtered(fact: Fact, by: Sequence[str], parts: Sequence[tuple]) -> Fact:
    """Rows of the entities: each level's names reach the files, several levels are then compared together."""
    for i, level in enumerate(by):
        fact = filter_entities(fact, level, [p[i] for p in parts])
    if len(by) == 1 or not parts:
        return fact
    values = zip(*(entity_values(fact, c, [p[i] for p in parts]) for i, c in enumerate(by)), strict=True)
    wanted = [reduce(and_, [F.col(c) == v for c, v in zip(by, row)]) for row in values]
    return fact.on(fact.df.filter(reduce(or_, wanted)))
