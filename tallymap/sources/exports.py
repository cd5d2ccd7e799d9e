"""CSV results.  Each export is a frame; ``write_csv`` puts it into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallymap.operators.anomaly import spike_detection
from tallymap.operators.cluster import clusters_with_category
from tallymap.operators.filters import filter_region
from tallymap.operators.rollup import rollup_by
from tallymap.operators.rules import RULES, recommendations
from tallymap.plans.dashboard import region_report
from tallymap.sources.csv_parts import CSV_FORMAT
from tallymap.spec import Fact, FactSet


def write_csv(df: DataFrame, path: str) -> None:
    """Part files with a header and texts as they are; the folder must not exist yet."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**CSV_FORMAT, **spaces).csv(path)


def export_rollup(fact: Fact, state: str | None = None, district: str | None = None) -> DataFrame:
    """Totals of the level below the selection in key order.

    Both filters always apply: a district without a state keeps that district
    and groups it by state.
    """
    wide, middle, fine = fact.spec.levels
    level = wide if not state else middle if not district else fine
    return rollup_by(filter_region(fact, state, district), [level]).orderBy(level)


def export_spikes(fact: Fact) -> DataFrame:
    """All spikes, not only the largest."""
    return spike_detection(fact, fact.spec.levels[0]).withColumnRenamed("deviation", "deviation_percent")


def export_clusters(facts: FactSet) -> DataFrame:
    return clusters_with_category(facts)


def export_recommendations(facts: FactSet, state: str | None = None) -> DataFrame:
    """The enrolment rule only."""
    scope = facts.map(lambda f: filter_region(f, state)) if state else facts
    return recommendations(scope, rules=[r for r in RULES if r.category == "enrollment"])


def export_region_report(facts: FactSet, level: str | None = "state") -> DataFrame:
    return region_report(facts, level).orderBy("name")
