from datetime import date

from tallymap.functions.columns import share, trunc_long, with_total
from tallymap.operators import joins, rollup, topk
from tallymap.operators.filters import date_range, filter_entities, filter_region, recent_activity
from tallymap.plans.dashboard import dashboard, kpi_dashboard, region_report
from tallymap.plans.profile import compare_entities, profile
from tallymap.sources.exports import export_rollup
from pyspark.sql import functions as F
from tests.frames import DEMO, fact, rows, series, three

D = date(2025, 1, 1)


def places(spark):
    return fact(spark, DEMO, [
        (D, "A", "X", 1, 5, 0), (D, "A", "X", 2, 0, 5), (D, "A", "Y", 3, 2, 2), (D, "B", "X", 4, 9, 1),
        (D, "B", None, 5, 1, 0), (D, None, "Z", 6, 7, 0), (D, "B", "W", None, 1, None),
    ])


def test_levels_drop_only_their_own_missing_keys(spark):
    f = places(spark)
    assert rows(rollup.rollup_by(f, ["state"]), "state") == [("A", 7, 7, 14), ("B", 11, 1, 12)]
    assert rows(rollup.rollup_by(f, ["district"]), "district") == [
        ("W", 1, 0, 1), ("X", 14, 6, 20), ("Y", 2, 2, 4), ("Z", 7, 0, 7)
    ]
    assert rollup.rollup_by(f, ["pincode"]).count() == 6


def test_drill_down_levels(spark):
    f = places(spark)
    assert [r.key for r in rollup.drill_down(f).collect()] == ["A", "B"]
    # A district without a state does not filter.
    assert rows(rollup.drill_down(f, district="X")) == rows(rollup.drill_down(f))
    assert [r.key for r in rollup.drill_down(f, "A").collect()] == ["X", "Y"]
    # Equal totals: smaller key first.
    assert [r.key for r in rollup.drill_down(f, "A", "X").collect()] == ["1", "2"]
    assert rollup.drill_down(f, "Nowhere").count() == 0


def test_all_levels_agree_with_single_levels(spark):
    f = places(spark)
    everything = rollup.drill_down_all(f)
    for level, n in (("state", 1), ("district", 2), ("pincode", 3)):
        keys = ["state", "district", "pincode"][:n]
        got = rows(everything.filter(F.col("level") == level).select(*keys, "total"), *keys)
        assert got == rows(rollup.rollup_by(f, keys).select(*keys, "total"), *keys)


def test_export_filters_by_district_alone(spark):
    assert rows(export_rollup(places(spark), district="X")) == [("A", 5, 5, 10), ("B", 9, 1, 10)]


def test_same_district_name_in_two_states(spark):
    f = places(spark)
    cover = rollup.coverage(f).first()
    assert (cover.states, cover.districts, cover.pincodes) == (2, 4, 6)
    assert filter_entities(f, "district", ["X"]).df.count() == 3
    assert filter_region(f, district="X").df.count() == 3
    assert filter_region(f, "A", "X").df.count() == 2
    assert filter_entities(f, "pincode", ["1", "abc", " 4 "]).df.count() == 2
    assert filter_entities(f, "pincode", []).df.count() == 0


def test_top_k_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([("c", 5), ("a", 5), ("b", 7), ("d", 5)], "state string, total int")
    assert [r.state for r in topk.top_k(df, "total", 3, ["state"]).collect()] == ["b", "a", "c"]
    sides = rows(topk.top_bottom(df, ["state"], k=2))
    assert sides == [("top", "b", 7), ("top", "a", 5), ("bottom", "d", 5), ("bottom", "c", 5)]
    per = topk.top_per_group(df.withColumn("g", F.lit(1)), "g", "total", 2, ["state"])
    assert sorted(r.state for r in per.collect()) == ["a", "b"]


def test_recent_days_are_inclusive(spark):
    f = series(spark, [1] * 40)
    assert recent_activity(f).df.count() == 31
    assert date_range(f, 7).df.count() == 8
    assert date_range(f).df.count() == 40


def test_shares_and_truncation(spark):
    row = spark.range(1).select(
        share(F.lit(1), F.lit(3)).alias("a"), share(F.lit(1), F.lit(0)).alias("b"),
        trunc_long(F.lit(-1.9)).alias("c"), trunc_long(F.lit(1.9)).alias("d"),
    ).first()
    assert tuple(row) == (33.33, 0.0, -1, 1)


def test_totals_treat_missing_as_zero(spark):
    f = places(spark)
    assert sorted(r.total for r in with_total(f.df, DEMO.measures).collect()) == [1, 1, 4, 5, 5, 7, 10]


def facts(spark):
    demo = [(D, "A", "X", 1, 100, 0), (D, "A", "X", 2, 0, 100), (D, "B", "Y", 3, 0, 0)]
    bio = [(D, "A", "X", 1, 30, 20), (D, "B", "Y", 3, 4, 0), (D, "C", "Q", 9, 4, 0)]
    enrol = [(D, "A", "X", 1, 1, 2, 3), (D, "C", "Q", 9, 1, 1, 1)]
    return three(spark, demo, bio, enrol)


def test_features_keep_entities_of_the_first_table(spark):
    f = facts(spark)
    assert rows(joins.entity_features(f.demographic, f.enrolment), "state") == [
        ("A", "X", 100, 100, 1, 2, 3, 2), ("B", "Y", 0, 0, 0, 0, 0, 1)
    ]
    fine = joins.entity_features(f.demographic, f.enrolment, "pincode")
    assert rows(fine, "pincode") == [
        ("A", "X", 1, 100, 0, 1, 2, 3), ("A", "X", 2, 0, 100, 0, 0, 0), ("B", "Y", 3, 0, 0, 0, 0, 0)
    ]


def test_ratios_are_zero_without_a_base(spark):
    f = facts(spark)
    assert rows(joins.dataset_totals(f, ["state"]), "state") == [("A", 200, 50, 6), ("B", 0, 4, 0)]
    ratio = rows(joins.coverage_ratio(f.biometric, f.demographic, ["state"]), "state")
    assert ratio == [("A", 50, 200, 25.0), ("B", 4, 0, 0.0), ("C", 4, 0, 0.0)]


def test_comparison_keeps_request_order_and_repeats(spark):
    got = compare_entities(facts(spark), "state", ["B", "C", "A", "B"]).collect()
    assert [(r.ord, r.entity) for r in got] == [(0, "B"), (2, "A"), (3, "B")]
    assert got[1].bio_coverage_percent == 25.0 and got[1].enrollment_rate == 3.0
    assert got[0].bio_coverage_percent == 0.0 and got[1].trend == "stable"
    assert got[1].districts == 1 and got[1].pincodes == 2
    fine = compare_entities(facts(spark), "pincode", ["x", "2"]).collect()
    assert [(r.entity, r.districts) for r in fine] == [("2", None)]


def test_profile_of_rows_with_missing_dates(spark):
    f = fact(spark, DEMO, [(D, "A", "X", 1, 5, 0), (None, "A", "X", 1, 100, 0), (D, "A", "Y", 2, 1, 1)])
    row = profile(f).first()
    assert (row.records, row.total, row.avg_daily, row.peak, row.peak_date) == (3, 107, 107, 7, D)
    assert row.growth_7 == 0.0
    assert profile(f.on(f.df.limit(0))).count() == 0


def test_overview_equals_cube_overview(spark):
    f = facts(spark)
    assert rows(rollup.overview(f)) == rows(rollup.overview(f.map(rollup.daily_cube)))
    assert rows(kpi_dashboard(f)) == rows(kpi_dashboard(f.map(rollup.daily_cube)))


def test_dashboard_and_region_report(spark):
    f = facts(spark)
    assert kpi_dashboard(f).first().coverage_percentage == 2 / 36 * 100
    parts = dashboard(f)
    assert [r.state for r in parts["alerts"].collect()] == ["B"]
    report = {r.name: r for r in region_report(f).collect()}
    assert report["A"].total_enrollments == 6 and report["A"].capacity_pct == 100.0
    assert report["B"].capacity_pct == 0.0 and report["B"].monthly_cost == 88000
