"""One function per analysis question, each giving the frames that make up the answer."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymap.operators import anomaly, cluster, forecast, rollup, stats, trends
from tallymap.operators.filters import filter_region
from tallymap.operators.rules import recommendations as fired_rules
from tallymap.plans import dashboard
from tallymap.plans.profile import compare_entities, profile, top_performers
from tallymap.spec import Fact, FactSet

Answer = dict[str, DataFrame]


def overview(facts: FactSet) -> Answer:
    return {"overview": rollup.overview(facts)}


def state_analysis(facts: FactSet, k: int = 15) -> Answer:
    wide = facts.demographic.spec.levels[0]
    return {
        "demographic": top_performers(facts.demographic, [wide], k),
        "enrollment": top_performers(facts.enrolment, [wide], k),
    }


def time_series(facts: FactSet) -> Answer:
    daily = rollup.daily_totals(facts.demographic)
    return {"daily": trends.time_series_panel(facts), "forecast": forecast.forecast_daily(daily)}


def clustering(facts: FactSet, k: int = 5) -> Answer:
    demo = facts.demographic
    assigned = cluster.kmeans_pincodes(demo, k)
    first, fine = demo.spec.measures[0], demo.spec.levels[-1]
    return {
        "clusters": cluster.cluster_centers(assigned, demo.spec.measures),
        "top": cluster.cluster_top(assigned, first, [fine]),
    }


def statistical_analysis(facts: FactSet) -> Answer:
    demo = facts.demographic
    return {
        "statistics": stats.describe_measures(demo),
        "correlation": stats.correlation(demo),
        "distribution": rollup.region_record_counts(demo, demo.spec.levels[0]),
    }


def geographic_heatmap(facts: FactSet) -> Answer:
    return {"heatmap": rollup.heatmap(facts.demographic)}


def predictive_model(
    facts: FactSet, state: str | None = None, district: str | None = None, as_of: date | None = None
) -> Answer:
    """Empty when the region has too few calendar days."""
    model = forecast.calendar_model(facts.demographic, state, district)
    if model is None:
        return {}
    return {
        "predictions": model.predict(as_of),
        "feature_importance": model.importance(),
        "model_score": forecast.model_score(model.fitted()),
    }


def anomaly_detection(facts: FactSet) -> Answer:
    return {"anomalies": anomaly.zscore_anomalies(facts.demographic)}


def district_ranking(facts: FactSet, k: int = 20) -> Answer:
    keys = list(facts.demographic.spec.levels[:2])
    return {
        "demographic": top_performers(facts.demographic, keys, k),
        "enrollment": top_performers(facts.enrolment, keys, k),
    }


def drill_down(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    return {"data": rollup.drill_down(facts.demographic, state, district)}


def spike_detection(facts: FactSet, k: int = 20) -> Answer:
    demo = facts.demographic
    keys = [demo.spec.date_col, demo.spec.levels[0]]
    spikes = anomaly.spike_detection(demo, keys[1])
    return {
        "spikes": anomaly.ranked_spikes(spikes, k, keys),
        "summary": anomaly.spike_summary(spikes, k, keys),
    }


def comparative_analysis(facts: FactSet, entities: Sequence, level: str = "state") -> Answer:
    return {"comparisons": compare_entities(facts, level, entities)}


def trend_analysis(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    scope = filter_region(facts.demographic, state, district)
    series = trends.moving_averages(rollup.daily_totals(scope), date=scope.spec.date_col)
    return {"daily": series, "summary": trends.trend_report(scope)}


def cluster_insights(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    return cluster.cluster_report(facts, state, district)


def government_dashboard(facts: FactSet) -> Answer:
    return dashboard.dashboard(facts)


def _analysis(fact: Fact, base: Fact | None, state: str | None, district: str | None) -> Answer:
    scope = filter_region(fact, state, district)
    other = filter_region(base, state, district) if base else None
    wide, middle, _ = fact.spec.levels
    states = top_performers(scope, [wide])
    return {
        "summary": profile(scope, other),
        "top_states": states.filter(F.lit(False)) if state else states,
        "top_districts": top_performers(scope, [wide, middle]),
    }


def demographic_analysis(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    scope = filter_region(facts.demographic, state, district)
    return {
        **_analysis(facts.demographic, None, state, district),
        "statistics": stats.describe_measures(scope).select("measure", "mean", "median", "std"),
    }


def biometric_analysis(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    return _analysis(facts.biometric, facts.demographic, state, district)


def enrollment_analysis(facts: FactSet, state: str | None = None, district: str | None = None) -> Answer:
    return _analysis(facts.enrolment, facts.demographic, state, district)


def recommendations(facts: FactSet, state: str | None = None) -> Answer:
    scope = facts.map(lambda f: filter_region(f, state))
    return {"recommendations": fired_rules(scope)}
