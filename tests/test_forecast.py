import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.operators import forecast
from tallymap.operators.rollup import daily_totals
from tests.frames import DAY0, series

VALUES = random.Random(5).choices(range(50, 150), k=60)


@pytest.mark.parametrize("n", [10, 11])
def test_forecast_needs_more_than_ten_days(spark, n):
    out = forecast.forecast_daily(daily_totals(series(spark, VALUES[:n])), rounds=5).orderBy("date").collect()
    if n == 10:
        assert out == []
    else:
        assert [r.date for r in out] == [DAY0 + timedelta(n + i) for i in range(30)]


def test_forecast_carries_the_last_level_on(spark):
    v = [100] * 30 + [200] * 30
    out = forecast.forecast_daily(daily_totals(series(spark, v)), rounds=40).collect()
    assert len({r.predicted_total for r in out}) == 1
    assert out[0].predicted_total in (199, 200)


def test_calendar_model(spark):
    f = series(spark, [300 if (DAY0 + timedelta(i)).weekday() == 6 else 100 for i in range(120)])
    model = forecast.calendar_model(f, trees=20)
    out = model.predict().orderBy("date").collect()
    assert [r.date for r in out] == [DAY0 + timedelta(120 + i) for i in range(7)]
    assert max(out, key=lambda r: r.predicted_total).date.weekday() == 6
    weights = {r.feature: r.importance for r in model.importance().collect()}
    assert sum(weights.values()) == pytest.approx(1) and max(weights, key=weights.get) == "day_of_week"
    assert model.score() == pytest.approx(forecast.model_score(model.fitted()).first().r2)
    later = model.predict(as_of=date(2026, 1, 1), horizon=2).orderBy("date").collect()
    assert [r.date for r in later] == [date(2026, 1, 2), date(2026, 1, 3)]


def test_calendar_model_needs_ten_rows(spark):
    assert forecast.calendar_model(series(spark, VALUES[:9])) is None
    # A district without a state does not filter.
    assert forecast.calendar_model(series(spark, VALUES[:20]), district="none", trees=2) is not None
    assert forecast.calendar_model(series(spark, VALUES[:20]), "none", trees=2) is None


def test_r_squared(spark):
    rng = np.random.default_rng(0)
    y, e = rng.normal(size=20), rng.normal(size=20) / 3
    df = spark.createDataFrame([(float(a), float(a + b)) for a, b in zip(y, e)], "y double, y_hat double")
    want = 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()
    assert forecast.model_score(df).first().r2 == pytest.approx(want)
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, y_hat double")
    assert forecast.model_score(flat).first().r2 is None


def test_flat_projection(spark):
    df = spark.createDataFrame([("A", 10, 50.0), ("B", 10, -200.0)], "state string, avg_daily int, growth double")
    out = forecast.flat_projection(
        df, F.col("avg_daily"), F.col("growth"), F.lit(date(2025, 1, 31))
    ).orderBy("state", "month").collect()
    assert [r.predicted for r in out] == [450.0] * 6 + [0.0] * 6
    assert [r.confidence for r in out[:6]] == [88, 81, 74, 67, 60, 53]
    assert out[0].month == date(2025, 2, 28)
