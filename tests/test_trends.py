import random
from datetime import timedelta
from statistics import mean, stdev

import pytest

from tallymap.operators import trends
from tallymap.operators.anomaly import (
    growth_anomaly,
    low_activity_alerts,
    spike_detection,
    spike_summary,
    zscore_anomalies,
)
from tallymap.operators.rollup import daily_by_region, daily_totals, time_rollup
from tests.frames import DAY0, DEMO, fact, rows, series

LENGTHS = [1, 6, 7, 8, 10, 30, 31, 36, 37, 38]


def values(n):
    return random.Random(n).choices(range(1, 100), k=n)


def change(new, old):
    return (mean(new) - mean(old)) / mean(old) * 100


@pytest.mark.parametrize("n", LENGTHS)
def test_growth_for_series_lengths(spark, n):
    v = values(n)
    daily = daily_totals(series(spark, v))
    week = trends.growth_rate_7(daily).first().growth
    assert week == pytest.approx(change(v[-7:], v[:7]) if n > 7 else 0)
    month = trends.growth_rate_30(daily).first().growth
    assert month == pytest.approx(change(v[-7:], v[-37:][:7]) if n > 30 else 0)


def test_growth_is_zero_when_nothing_was_there(spark):
    daily = daily_totals(series(spark, [0] * 7 + [5] * 8))
    assert trends.growth_rate_7(daily).first().growth == 0.0


@pytest.mark.parametrize("gap", [1, 5])
def test_windows_count_rows_not_days(spark, gap):
    v = values(40)
    out = trends.moving_averages(daily_totals(series(spark, v, gap=gap))).orderBy("date").collect()
    for i, r in enumerate(out):
        assert r.avg_7 == pytest.approx(mean(v[max(0, i - 6): i + 1]))
        assert r.avg_30 == pytest.approx(mean(v[max(0, i - 29): i + 1]))


def test_rolling_deviation_is_missing_on_the_first_row(spark):
    v = values(12)
    out = trends.rolling_stats(daily_by_region(series(spark, v))).orderBy("date").collect()
    assert out[0].rolling_std is None
    assert out[9].rolling_std == pytest.approx(stdev(v[3:10]))
    prior = trends.rolling_stats(daily_by_region(series(spark, v)), baseline="prior").orderBy("date").collect()
    assert prior[0].rolling_avg is None and prior[9].rolling_avg == pytest.approx(mean(v[2:9]))


def test_earliest_day_wins_ties(spark):
    row = trends.peak_low(daily_totals(series(spark, [3, 9, 1, 9, 1]))).first()
    assert (row.peak_date, row.low_date) == (DAY0 + timedelta(1), DAY0 + timedelta(2))


def test_trend_label_counts_records(spark):
    def label(counts):
        many = [(DAY0 + timedelta(i), "A", "D", 1, 1, 1) for i, c in enumerate(counts) for _ in range(c)]
        return trends.trend_label(trends.record_series(fact(spark, DEMO, many))).first().trend

    assert label([1, 2]) == "stable"  # both windows hold both days
    assert label([5]) == "stable"
    assert label([1] * 7 + [3]) == "increasing"
    assert label([3] + [1] * 7) == "decreasing"


def test_short_series_have_no_report(spark):
    assert trends.trend_report(series(spark, values(6))).count() == 0
    row = trends.trend_report(series(spark, values(7))).first()
    assert row.n_days == 7 and row.average == pytest.approx(mean(values(7)))


def test_week_starts_on_monday(spark):
    weeks = rows(time_rollup(series(spark, [1] * 10), "week"), "period")
    assert [w[0].weekday() for w in weeks] == [0] * len(weeks)
    assert sum(w[-1] for w in weeks) == 10


def test_constant_series_has_no_zscore(spark):
    assert zscore_anomalies(series(spark, [5] * 20)).count() == 0
    assert zscore_anomalies(series(spark, [5])).count() == 0
    found = zscore_anomalies(series(spark, [5] * 20 + [90])).collect()
    assert [r.total for r in found] == [90]


def test_trailing_spikes_are_bounded(spark):
    flat = [10] * 20 + [10_000] + [10] * 19
    found = spike_detection(series(spark, flat)).collect()
    assert [(r.value, r.severity) for r in found] == [(10_000, "medium")]
    bound = (found[0].value - found[0].rolling_avg) / found[0].rolling_std
    assert bound == pytest.approx(6 / 7**0.5)
    prior = spike_detection(series(spark, [10, 12] * 10 + [500]), baseline="prior").collect()
    assert prior[-1].severity == "high"


def test_regions_below_the_day_limit_are_skipped(spark):
    assert spike_detection(series(spark, [1, 1, 1, 1, 1, 99])).count() == 0
    assert spike_detection(series(spark, [1, 1, 1, 1, 1, 1, 99])).count() == 1


def test_spikes_equal_a_loop_over_regions(spark):
    v = {s: values(60 + i) for i, s in enumerate("ABC")}
    every = [(DAY0 + timedelta(i), s, "D", 1, t, 0) for s in v for i, t in enumerate(v[s])]
    want = set()
    for s in v:
        for i, t in enumerate(v[s]):
            w = v[s][max(0, i - 6): i + 1]
            if len(w) > 1 and t > mean(w) + 2 * stdev(w):
                want.add((DAY0 + timedelta(i), s, t))
    f = fact(spark, DEMO, every)
    got = spike_detection(f)
    assert {(r.date, r.state, r.value) for r in got.collect()} == want
    summary = spike_summary(got, k=2).first()
    assert (summary.total_spikes, summary.uncut_spikes) == (min(2, len(want)), len(want))


def test_low_activity_lists_the_least_severe_first(spark):
    totals = {"A": 1000, "B": 10, "C": 20, "D": 1}
    f = fact(spark, DEMO, [(DAY0, s, "D", 1, t, 0) for s, t in totals.items()])
    assert [r.state for r in low_activity_alerts(f).collect()] == ["C", "B", "D"]
    assert [r.state for r in low_activity_alerts(f, k=2).collect()] == ["C", "B"]
    assert low_activity_alerts(f, k=None).count() == 3


def test_growth_anomaly_needs_more_than_the_limit(spark):
    assert growth_anomaly(series(spark, [10] * 7 + [11] * 7)).count() == 0
    assert growth_anomaly(series(spark, [100] * 7 + [89] * 7)).first().growth == -11.0
