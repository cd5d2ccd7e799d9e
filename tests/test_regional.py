import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallymap.operators import regional
from tests.frames import DAY0, DEMO, fact


def table(spark, **regions):
    """One row per region and day; a region is (totals, gap in days)."""
    rows = []
    for state, (totals, gap) in regions.items():
        rows += [(DAY0 + timedelta(days=i * gap), state, "D", 1, t, 0) for i, t in enumerate(totals)]
    return fact(spark, DEMO, rows)


NOISE = random.Random(5).choices(range(80, 120), k=90)
STEP = [100] * 60 + [300] * 30
BIG = [1000 * n for n in NOISE]


def answers(df, *columns):
    out = {}
    for r in df.orderBy("state", "date").collect():
        out.setdefault(r.state, []).append(tuple(r[c] for c in columns))
    return out


def test_every_region_carries_its_own_last_level_on(spark):
    f = table(spark, step=(STEP, 1), big=(BIG, 1), weekly=(NOISE[:40], 7), short=(NOISE[:10], 1), flat=([7] * 50, 1), none=([0] * 50, 1))
    ahead = answers(regional.forecast_levels(regional.region_days(f, ["state"]), ["state"], rounds=30), "date", "predicted_total")
    assert set(ahead) == {"step", "big", "weekly", "flat", "none"}
    sizes = {"step": (90, 1), "big": (90, 1), "weekly": (40, 7), "flat": (50, 1), "none": (50, 1)}
    for state, (n, gap) in sizes.items():
        last = DAY0 + timedelta(days=(n - 1) * gap)
        assert [d for d, _ in ahead[state]] == [last + timedelta(days=i) for i in range(1, 31)]
        assert len({t for _, t in ahead[state]}) == 1
    level = {state: rows[0][1] for state, rows in ahead.items()}
    assert level["flat"] == 7 and level["none"] == 0
    assert 250 <= level["step"] <= 300 and min(BIG) <= level["big"] <= max(BIG)


def test_lags_follow_trends_and_weekdays(spark):
    trend = [50 + 3 * i for i in range(120)]
    weekend = [300 if (DAY0 + timedelta(i)).weekday() >= 5 else 100 for i in range(120)]
    f = table(spark, trend=(trend, 1), weekend=(weekend, 1), noise=(NOISE, 1), short=(NOISE[:28], 1), none=([0] * 40, 1))
    ahead = answers(regional.forecast_lagged(regional.region_days(f, ["state"]), ["state"]), "date", "predicted_total")
    assert set(ahead) == {"trend", "weekend", "noise", "none"}
    assert all(len(rows) == 30 for rows in ahead.values())
    assert {t for _, t in ahead["none"]} == {0}
    for d, t in ahead["weekend"]:
        assert abs(t - (300 if d.weekday() >= 5 else 100)) < 60
    totals = [t for _, t in ahead["trend"]]
    assert totals[-1] > totals[0] > 350
    assert all(0 <= t <= 2 * 119 for _, t in ahead["noise"])


def test_backtest_on_a_trend(spark):
    f = table(spark, up=([20 + 5 * i for i in range(120)], 1), gaps=([10 + 2 * i for i in range(100)], 3), short=(NOISE[:40], 1))
    found = {r.state: r for r in regional.backtest(regional.region_days(f, ["state"]), ["state"], rounds=10).collect()}
    assert set(found) == {"up", "gaps"}
    for r in found.values():
        assert r.n_days == 30 and r.lagged_error < r.flat_error / 2
    assert found["up"].actual == sum(20 + 5 * i for i in range(90, 120))


def test_calendar_of_every_region(spark):
    sunday = [300 if (DAY0 + timedelta(i)).weekday() == 6 else 100 for i in range(120)]
    monday = [9000 if (DAY0 + timedelta(i)).weekday() == 0 else 1000 for i in range(100)]
    f = table(spark, sunday=(sunday, 1), monday=(monday, 1), constant=([50] * 30, 1), short=(NOISE[:9], 1))
    model = regional.calendar_models(f, ["state"], trees=10)
    ahead = answers(model.predict(), "date", "predicted_total")
    assert set(ahead) == {"sunday", "monday", "constant"}
    assert [d for d, _ in ahead["monday"]] == [DAY0 + timedelta(100 + i) for i in range(7)]
    for state, weekday in (("sunday", 6), ("monday", 0)):
        assert max(ahead[state], key=lambda r: r[1])[0].weekday() == weekday
    assert {t for _, t in ahead["constant"]} == {50}
    scores = {r.state: r.r2 for r in model.scores().collect()}
    assert scores["constant"] is None and scores["sunday"] > 0.8 and scores["monday"] > 0.8
    assert sum(r.importance for r in model.importance().collect()) == pytest.approx(1)
    assert model.score().first().r2 > 0.8


@pytest.mark.parametrize("ask", [regional.forecast_levels, regional.forecast_lagged])
def test_nothing_to_learn_from(spark, ask):
    empty = regional.region_days(table(spark), ["state"])
    assert ask(empty, ["state"]).count() == 0
    assert ask(regional.region_days(table(spark, short=(NOISE[:5], 1)), ["state"]), ["state"]).count() == 0


def test_calendar_needs_rows(spark):
    assert regional.calendar_models(table(spark), ["state"], trees=2) is None
    assert regional.calendar_models(table(spark, short=(NOISE[:9], 1)), ["state"], trees=2) is None


def test_the_facts_are_read_once(spark, tmp_path):
    f = table(spark, a=(NOISE, 1), b=(STEP, 1))
    f.df.write.parquet(str(tmp_path / "facts"))
    stored = f.on(spark.read.parquet(str(tmp_path / "facts")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(regional.daily_by(stored, ["state"])).count("FileScan") == 1
    model = regional.calendar_models(stored, ["state"], trees=2)
    days = regional.region_days(stored, ["state"])
    for df in (model.rows, model.regions, model.predict(), model.scores(), regional.forecast_lagged(days, ["state"])):
        assert str(tmp_path) not in plan(df)


def test_country_as_one_region(spark):
    f = table(spark, a=(NOISE, 1), b=(STEP, 1))
    ahead = regional.forecast_levels(regional.region_days(f, []), [], rounds=5)
    assert ahead.columns == ["date", "predicted_total"] and ahead.count() == 30
    assert ahead.agg(F.min("date")).first()[0] == date(2025, 3, 1) + timedelta(90)
