"""Random tables with gaps, repeats and missing values against plain pandas."""

import random
from datetime import date, timedelta

import pandas as pd
import pytest

from tallymap.operators import anomaly, capacity, joins, rollup, rules, trends
from tallymap.plans.dashboard import kpi_dashboard, region_report
from tallymap.plans.profile import compare_entities, profile
from tests.frames import BIO, DEMO, ENROL, three

KEYS = ["date", "state", "district", "pincode"]


def random_rows(rng, n_measures, n):
    def maybe(value):
        return None if rng.random() < 0.06 else value

    out = []
    for _ in range(n):
        s = rng.choice("ABCD")
        d = rng.choice("XYZ") if rng.random() < 0.3 else s + rng.choice("12")
        day = date(2025, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 3, 5, 8, 9, 10, 14, 20, 21, 33, 34, 50]))
        out.append((maybe(day), maybe(s), maybe(d), maybe(rng.randrange(1, 9)),
                    *[maybe(rng.randrange(0, 50)) for _ in range(n_measures)]))
    return out


@pytest.fixture(scope="module", params=[1, 2, 3])
def tables(request, spark):
    rng = random.Random(request.param)
    data = [random_rows(rng, 2, 260), random_rows(rng, 2, 90), random_rows(rng, 3, 70)]
    facts = three(spark, *data)
    frames = []
    for rows, spec in zip(data, (DEMO, BIO, ENROL)):
        frame = pd.DataFrame(rows, columns=[*KEYS, *spec.measures])
        frame["date"] = pd.to_datetime(frame["date"])
        frame["total"] = frame[list(spec.measures)].fillna(0).sum(axis=1)
        frames.append(frame)
    return facts, frames


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def growth_7(daily):
    if len(daily) <= 7:
        return 0.0
    new, old = daily.tail(7).mean(), daily.head(7).mean()
    return (new - old) / old * 100 if old > 0 else 0.0


@pytest.mark.parametrize("level", ["state", "district", "pincode"])
def test_rollup(tables, level):
    facts, (demo, _, _) = tables
    want = demo.groupby(level)["total"].sum().to_dict()
    assert as_dict(rollup.rollup_by(facts.demographic, [level]), level, "total") == want


def test_overview_and_dashboard(tables):
    facts, frames = tables
    demo, bio, enrol = frames
    row = rollup.overview(facts).first()
    assert [row.demo_records, row.bio_records, row.enrol_records] == [len(f) for f in frames]
    assert (row.states, row.districts, row.pincodes) == tuple(demo[c].nunique() for c in KEYS[1:])
    assert (row.d1, row.b2, row.e3) == (demo.d1.sum(), bio.b2.sum(), enrol.e3.sum())
    assert row.start_date == demo.date.min().date() and row.end_date == demo.date.max().date()
    kpi = kpi_dashboard(facts).first()
    since = demo.date.max() - pd.Timedelta(days=30)
    assert kpi.recent_30_days == (demo.date >= since).sum() + (enrol.date >= since).sum()
    assert kpi.total_records == sum(len(f) for f in frames)


def test_features(tables):
    facts, (demo, _, enrol) = tables
    left = demo.groupby(["state", "district"]).agg(d1=("d1", "sum"), n=("pincode", "nunique"))
    right = enrol.groupby(["state", "district"]).agg(e2=("e2", "sum"))
    want = left.join(right, how="left").fillna(0)
    got = {(r.state, r.district): (r.d1, r.n_pincodes, r.e2)
           for r in joins.entity_features(facts.demographic, facts.enrolment).collect()}
    assert got == {k: (v.d1, v.n, v.e2) for k, v in want.iterrows()}


@pytest.mark.parametrize("by", ["", "state", "pincode"])
def test_profile(tables, by):
    facts, (demo, _, enrol) = tables
    got = profile(facts.demographic, facts.enrolment, [by] if by else []).collect()
    groups = demo.groupby(by) if by else [(None, demo)]
    found = {r[by] if by else None: r for r in got}
    assert len(got) == len(groups)
    for name, part in groups:
        r = found[name]
        daily = part.groupby("date")["total"].sum()
        base = enrol[enrol[by] == name] if by else enrol
        whole = part.total.sum()
        assert (r.records, r.total) == (len(part), whole)
        assert (r.states, r.districts, r.pincodes) == tuple(part[c].nunique() for c in KEYS[1:])
        assert r.avg_daily == int(whole / max(len(daily), 1))
        assert r.growth_7 == pytest.approx(growth_7(daily), abs=0.00501)
        assert (r.peak, r.peak_date) == (daily.max(), daily.idxmax().date())
        rate = whole / base.total.sum() * 100 if base.total.sum() > 0 else 0
        assert r.rate == pytest.approx(rate, abs=0.00501)


@pytest.mark.parametrize("level", ["state", "district", "pincode"])
def test_comparison(tables, level):
    facts, (demo, bio, enrol) = tables
    names = ["A", "D", "Q", "B"] if level == "state" else ["X", "A1", "C2"] if level == "district" else ["1", "8", "x"]
    want = []
    for name in names:
        key = int(name) if level == "pincode" and name.isdigit() else name
        part = demo[demo[level] == key]
        if len(part) == 0:
            continue
        counts = part.groupby("date").size()
        new, old = counts.tail(7).mean(), counts.head(7).mean()
        trend = "stable" if len(counts) <= 1 or new == old else "increasing" if new > old else "decreasing"
        want.append((
            name, part.total.sum(), bio[bio[level] == key].total.sum(), enrol[enrol[level] == key].total.sum(),
            int(part.total.sum() / max(len(counts), 1)), trend,
            part.district.nunique() if level == "state" else None, part.pincode.nunique(),
        ))
    got = compare_entities(facts, level, names).collect()
    assert [tuple(r)[1:9] for r in got] == want


def test_trends_per_state(tables):
    facts, (demo, _, _) = tables
    report = {r.state: r for r in trends.trend_report(facts.demographic, ["state"]).collect()}
    for state, part in demo.groupby("state"):
        daily = part.groupby("date")["total"].sum()
        assert (state in report) == (len(daily) >= 7)
        if state in report:
            r = report[state]
            assert r.average == pytest.approx(daily.mean()) and r.volatility == pytest.approx(daily.std())
            assert (r.low, r.low_date) == (daily.min(), daily.idxmin().date())


def test_spikes_and_zscores(tables):
    facts, (demo, _, _) = tables
    want = set()
    for state, part in demo.groupby("state"):
        daily = part.groupby("date")["total"].sum()
        if len(daily) < 7:
            continue
        roll = daily.rolling(7, min_periods=1)
        hit = daily > roll.mean() + 2 * roll.std()
        want |= {(state, d.date()) for d in daily[hit].index}
    assert {(r.state, r.date) for r in anomaly.spike_detection(facts.demographic).collect()} == want
    daily = demo.groupby("date")["total"].sum()
    z = (daily - daily.mean()) / daily.std()
    found = {r.date for r in anomaly.zscore_anomalies(facts.demographic, 1.0).collect()}
    assert found == {d.date() for d in z[z.abs() > 1].index}


def test_capacity_and_region_report(tables):
    facts, (demo, bio, enrol) = tables
    load = {r.state: r for r in capacity.capacity_utilization(facts.enrolment).collect()}
    report = {r.name: r for r in region_report(facts).collect()}
    assert set(report) == {s for f in (demo, bio, enrol) for s in f.state.dropna()}
    for state, part in enrol.groupby("state"):
        dated = part.dropna(subset=["date"])
        daily = dated.groupby("date")["total"].sum()
        average = int(part.total.sum() / max(len(daily), 1))
        assert load[state].avg_daily == average and load[state].peak == daily.max()
        assert report[state].avg_daily == average
        assert report[state].total_enrollments == part.total.sum()
        assert report[state].peak == daily.max()
        assert report[state].d1 == demo[demo.state == state].d1.sum()


def test_rules_per_state(tables):
    facts, (demo, bio, enrol) = tables
    want = set()
    for state, part in demo.groupby("state"):
        total = part.total.sum()
        if enrol[enrol.state == state].total.sum() < total * 0.5:
            want.add((state, "enrollment"))
        if part.pincode.nunique() < part.district.nunique() * 10:
            want.add((state, "coverage"))
        if part.d1.sum() < part.d2.sum() * 0.3:
            want.add((state, "demographics"))
        if bio[bio.state == state].total.sum() < total * 0.7:
            want.add((state, "biometric"))
    assert {(r.state, r.category) for r in rules.recommendations(facts, ["state"]).collect()} == want
