"""Rule-based recommendations for every region in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.functions.columns import present, share, total
from tallymap.functions.shape import distinct_places, fold_places
from tallymap.spec import FactSet


@dataclass(frozen=True)
class Rule:
    """Fires for a region when ``value`` is below ``factor`` times ``base``."""

    category: str
    priority: str
    value: str
    base: str
    factor: float
    code: str


# Category, priority, compared quantities and factor of each rule.
RULES = (
    Rule("enrollment", "high", "enrol_total", "demo_total", 0.5, "enrolments_low"),
    Rule("coverage", "medium", "n_pincodes", "n_districts", 10, "postcodes_sparse"),
    Rule("demographics", "high", "child_total", "adult_total", 0.3, "children_few"),
    Rule("biometric", "medium", "bio_total", "demo_total", 0.7, "biometrics_behind"),
)


def region_balance(facts: FactSet, by: Sequence[str] = ()) -> DataFrame:
    """What the rules look at: totals of the tables, child and adult sums, coverage."""
    spec = facts.demographic.spec
    child, adult = spec.measures[:2]
    known = f"{spec.name}_records"
    _, middle, fine = spec.levels
    totals = present(fold_places(facts), by).groupBy(*by).agg(
        *[
            F.sum(total(f.spec.measures)).alias(n)
            for f, n in zip(facts.all(), ("demo_total", "bio_total", "enrol_total"))
        ],
        F.sum(child).alias("child_total"),
        F.sum(adult).alias("adult_total"),
        F.sum(known).alias("known"),
        *distinct_places([middle, fine]),
    )
    renamed = totals.withColumnsRenamed({f"{middle}s": "n_districts", f"{fine}s": "n_pincodes"})
    return renamed.filter(F.col("known") > 0).drop("known")


def _advice(rule: Rule) -> Column:
    value, limit = F.col(rule.value), F.col(rule.base) * F.lit(rule.factor)
    return F.when(
        value < limit,
        F.struct(
            F.lit(rule.priority).alias("priority"),
            F.lit(rule.category).alias("category"),
            F.lit(rule.code).alias("code"),
            value.cast("double").alias("value"),
            limit.cast("double").alias("limit"),
            (limit - value).cast("double").alias("gap"),
            share(value, F.col(rule.base), 1).alias("percent"),
        ),
    )


def recommendations(
    facts: FactSet, by: Sequence[str] = (), rules: Sequence[Rule] = RULES, texts: DataFrame | None = None
) -> DataFrame:
    """Rules that fire, one row per region and rule; without ``by`` the whole country is the region.

    A row holds the numbers behind the rule: value, limit, what is missing to the limit
    (``gap``) and the percentage of the base.  ``texts`` is a table with a ``code`` column and
    whatever is to be said about it (titles, actions, impact); codes without a text keep NULLs.
    """
    fired = F.array_compact(F.array(*[_advice(r) for r in rules]))
    found = region_balance(facts, by).select(*by, F.inline(fired))
    return found if texts is None else found.join(texts, "code", "left")
