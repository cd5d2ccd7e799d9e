"""What must hold for the plans, whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallymap import Fact
from tallymap.operators import anomaly, rollup, trends
from tallymap.operators.filters import filter_entities, filter_region, recent_activity
from tallymap.operators.joins import entity_features
from tallymap.operators.rules import recommendations
from tallymap.operators.stats import describe_measures
from tallymap.plans.profile import profile
from tallymap.sources import fixtures
from tallymap.spec import FactSet


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The fixture facts as parquet files, the way a cluster would hold them."""

    def save(f):
        path = str(tmp_path_factory.mktemp("facts") / f.spec.name)
        f.df.write.parquet(path)
        return Fact(spark.read.parquet(path), f.spec)

    return fixtures.facts(spark, sf_dir).map(save)


EAGER = {"export", "scan_parts", "load_facts", "kmeans", "cluster_report", "silhouette", "davies",
         "cluster_quality", "overview_of_saved", "forecast", "calendar_model", "feature_importance"}
LAZY = [n for n in sorted(entry.queries()) if not any(n.startswith(e) for e in EAGER)]


@pytest.mark.parametrize("name", LAZY)
def test_no_pairwise_join(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_region_filters_reach_the_files(stored):
    text = plan(rollup.rollup_by(filter_region(stored.demographic, "ASIA"), ["district"]))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(state,ASIA\)", text)
    schema = re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "pincode" not in schema and "date" not in schema
    text = plan(filter_entities(stored.demographic, "pincode", ["1", "2"]).df)
    assert re.search(r"PushedFilters: \[[^\]]*In\(pincode", text)


def test_rows_are_folded_before_they_are_shuffled(stored):
    for df in (
        rollup.daily_by_region(stored.demographic),
        entity_features(stored.demographic, stored.enrolment),
        recommendations(stored, ["state"]),
        rollup.overview(stored),
        describe_measures(stored.demographic),
    ):
        text = plan(df)
        first_shuffles = [m for m in re.finditer(r"Exchange hashpartitioning[^\n]*\n[^\n]*", text)]
        assert first_shuffles
        assert "partial_" in text
        # No exchange sits directly on a scan.
        assert not re.search(r"Exchange hashpartitioning[^\n]*\n[ :+\-]*\*?\(?\d*\)? ?(FileScan|Scan)", text)


def test_each_table_is_scanned_once(stored):
    for df in (
        rollup.overview(stored),
        rollup.drill_down_all(stored.demographic),
        recommendations(stored),
        entity_features(stored.demographic, stored.enrolment),
    ):
        text = plan(df)
        paths = re.findall(r"Location: InMemoryFileIndex[^\[]*\[([^,\]]+)", text)
        assert len(paths) == len(set(paths)), paths


def test_top_k_needs_no_sort_of_everything(stored):
    assert "TakeOrderedAndProject" in plan(rollup.heatmap(stored.demographic))


def test_spikes_shuffle_days_only(stored):
    text = plan(anomaly.spike_detection(stored.demographic))
    # by (date, state) for the sums, by state for the window
    assert text.count("Exchange hashpartitioning") == 2


def test_group_limit_before_the_shuffle(stored):
    from tallymap.operators.topk import top_per_group

    totals = rollup.rollup_by(stored.demographic, ["state", "pincode"])
    assert "WindowGroupLimit" in plan(top_per_group(totals, "state", "total", 5, ["pincode"]))


def test_recent_days_filter_the_scan(stored):
    text = plan(recent_activity(stored.demographic).df)
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(date,\d{4}-\d\d-\d\d\)", text)
    assert "subquery" not in text.lower() and "Join" not in text


@pytest.fixture(scope="module")
def skewed(stored):
    """Two thirds of all rows belong to one finest region of one day."""

    def pile(f):
        hot = f.df.filter(F.col("pincode").isNotNull()).limit(1)
        n = 2 * f.df.count()
        copies = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("copy")
        return f.on(f.df.unionByName(copies))

    return FactSet(*(pile(f) for f in stored.all()))


def test_skewed_table_gives_whole_results(skewed):
    demo = skewed.demographic
    n = demo.df.count()
    assert profile(demo).first().records == n
    assert rollup.overview(skewed).first().updates_records == n
    total = demo.df.agg(F.sum(F.col("upd_new") + F.col("upd_old"))).first()[0]
    for level in ("state", "district", "pincode"):
        assert rollup.rollup_by(demo, [level]).agg(F.sum("total")).first()[0] == total
    assert trends.trend_report(demo).first().n_days == demo.df.select("date").distinct().count()
    described = {r.measure: r for r in describe_measures(demo).collect()}
    want = demo.df.agg(*[F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in described]).first()
    for m, r in described.items():
        assert [r.q1, r.median, r.q3] == list(want[m])


# The country as a whole is one series with one row per day.
ONE_SERIES = {
    "growth_rate_7", "growth_rate_30", "model_score", "moving_averages", "profile_biometric", "profile_demographic",
    "profile_enrollment", "quality_report", "quality_score", "trend_report", "zscore_anomalies",
}


def test_only_country_wide_daily_series_meet_in_one_task(spark, sf_dir):
    found = set()
    for name in LAZY:
        lines = plan(entry.queries()[name](spark, sf_dir)).split("\n")
        for line, below in zip(lines, lines[1:]):
            if "Exchange SinglePartition" in line and "Aggregate" not in below and "Limit" not in below:
                found.add(name)
            if re.search(r"\bWindow \[", line) and "SinglePartition" in below:
                found.add(name)
    assert found <= ONE_SERIES
