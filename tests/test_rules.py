from datetime import timedelta

import pytest

from tallymap.operators import capacity, rules
from tallymap.sources.exports import export_recommendations, export_spikes
from tests.frames import DAY0, rows, series, three

LOADS = [("a", 0, 0), ("b", 150, 150), ("c", 151, 400), ("d", 999, 1000), ("e", 10001, 10001), ("f", 1, 5)]


@pytest.fixture(scope="module")
def costs(spark):
    df = spark.createDataFrame(LOADS, "state string, avg_daily bigint, peak bigint")
    return capacity.cost_model(df)


def test_cost_model(costs):
    c = {r.state: r for r in costs.collect()}
    assert (c["a"].staff, c["a"].monthly, c["a"].cost_per_enrollment, c["a"].productivity) == (0, 88000, 0.0, 0.0)
    assert (c["b"].staff, c["c"].staff, c["c"].peak_staff) == (1, 2, 3)
    assert c["b"].monthly == 113000 and c["b"].annual == 1356000
    assert c["b"].cost_per_enrollment == round(113000 / 4500, 2)
    assert c["c"].productivity == 76.0 and c["e"].revenue == 10001 * 3000


def test_cost_advice(costs):
    flags = {}
    for r in capacity.cost_advice(costs).collect():
        flags.setdefault(r.state, set()).add(r.flag)
    assert flags["a"] == {"staff_balanced", "cost_optimal", "volume_low"}  # cost 0 counts as optimal
    assert flags["c"] == {"staff_balanced", "cost_optimal", "volume_low"}  # 3 staff is not above 2 x 1.5
    assert flags["e"] == {"staff_share_high", "staff_balanced", "cost_optimal", "volume_high"}
    assert flags["f"] == {"cost_high", "staff_balanced", "volume_low"}


def test_resource_plan(costs):
    plan = {r.state: r for r in capacity.resource_plan(costs).collect()}
    assert (plan["a"].centers, plan["a"].peak_centers, plan["a"].savings) == (0, 1, 0.0)
    assert (plan["e"].centers, plan["e"].peak_centers, plan["e"].savings) == (51, 51, 200.0)


def test_capacity_per_region(spark):
    out = capacity.capacity_utilization(series(spark, [10, 20, 30])).first()
    assert (out.avg_daily, out.peak, out.capacity, out.efficient) == (20, 30, 66.7, False)
    empty = capacity.capacity_utilization(series(spark, [0, 0])).first()
    assert (empty.capacity, empty.efficient) == (0.0, False)


def test_capacity_advice(spark):
    load = series(spark, [10, 10, 30])
    growing = series(spark, [10] * 7 + [20] * 7)
    got = capacity.capacity_advice(load, growing).collect()
    assert {(r.priority, r.code) for r in got} == {("Medium", "underused"), ("Medium", "trend_change")}
    steady = capacity.capacity_advice(series(spark, [9, 10]), series(spark, [1] * 14)).collect()
    assert [(r.priority, r.code) for r in steady] == [("High", "strained")]


def facts(spark):
    demo = [(DAY0, "A", "X", 1, 20, 80), (DAY0, "B", "Y", 2, 50, 50)]
    demo += [(DAY0, "B", "Y", 10 + i, 0, 0) for i in range(9)]
    bio = [(DAY0, "A", "X", 1, 69, 0), (DAY0, "B", "Y", 2, 70, 0), (DAY0, "C", "Z", 3, 1, 1)]
    enrol = [(DAY0, "A", "X", 1, 49, 0, 0), (DAY0, "B", "Y", 2, 50, 0, 0)]
    return three(spark, demo, bio, enrol)


def test_rules_fire_below_their_thresholds(spark):
    got = rules.recommendations(facts(spark), ["state"]).collect()
    fired = {(r.state, r.category): r.priority for r in got}
    assert fired == {
        ("A", "enrollment"): "high", ("A", "coverage"): "medium", ("A", "demographics"): "high",
        ("A", "biometric"): "medium",
    }
    assert all(r.gap == pytest.approx(r.limit - r.value) and r.gap > 0 for r in got)
    said = spark.createDataFrame([("children_few", "visit schools")], "code string, text string")
    texts = {r.code: r.text for r in rules.recommendations(facts(spark), ["state"], texts=said).collect()}
    assert texts == {
        "enrolments_low": None, "postcodes_sparse": None, "children_few": "visit schools", "biometrics_behind": None,
    }
    country = {r.category: (r.value, r.limit) for r in rules.recommendations(facts(spark)).collect()}
    assert country == {"enrollment": (99.0, 100.0), "coverage": (11.0, 20.0)}


def test_exports(spark):
    f = facts(spark)
    country = export_recommendations(f).first()
    assert (country.priority, country.category, country.percent) == ("high", "enrollment", 49.5)
    assert (country.value, country.limit, country.gap) == (99.0, 100.0, 1.0)
    assert rows(export_recommendations(f, "B")) == []
    assert export_recommendations(f, "A").first().percent == 49.0
    spikes = export_spikes(series(spark, [1] * 10 + [50]))
    assert spikes.columns == [
        "date", "state", "value", "rolling_avg", "rolling_std", "deviation_percent", "severity"
    ]
    assert spikes.first().date == DAY0 + timedelta(10)


def test_coverage_summary_without_base(spark):
    got = rows(capacity.coverage_summary(facts(spark)), "state")
    assert got == [("A", 204.1, 69.0), ("B", 200.0, 70.0)]
    lonely = three(spark, [(DAY0, "A", "X", 1, 1, 1)])
    assert rows(capacity.coverage_summary(lonely)) == [("A", None, 0.0)]


def test_country_is_one_region(spark):
    f = facts(spark)
    load = capacity.capacity_utilization(f.demographic, [])
    assert load.columns[0] == "avg_daily" and load.first().avg_daily == 200
    assert capacity.resource_plan(load, []).first().centers == 1
    assert capacity.cost_advice(capacity.cost_model(load), []).count() == 3
    assert rows(capacity.coverage_summary(f, [])) == [(202.0, 70.5)]
    assert {r.code for r in capacity.capacity_advice(f.demographic, f.demographic, []).collect()} == {"strained"}
