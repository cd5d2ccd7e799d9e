import math
import random
from datetime import date

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymap import Fact
from tallymap.operators.quality import quality_report, quality_score
from tallymap.operators.stats import correlation, describe_measures, statistical_report
from tests.frames import DAY0, DEMO, fact, three


def two_columns(spark, a, b):
    return fact(spark, DEMO, [(DAY0, "A", "D", 1, x, y) for x, y in zip(a, b)])


def check(spark, a):
    out = {r.measure: r for r in describe_measures(two_columns(spark, a, a[::-1])).collect()}
    for r in out.values():
        assert r["min"] == min(a) and r["max"] == max(a)
        assert r["mean"] == pytest.approx(np.mean(a))
        if len(a) > 1:
            assert r["std"] == pytest.approx(np.std(a, ddof=1), abs=1e-9)
        else:
            assert r["std"] is None
        for name, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)):
            assert r[name] == pytest.approx(np.quantile(a, q))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60))
def test_quantiles_equal_sorting(spark, a):
    check(spark, a)


def test_quantiles_with_a_heavy_value_and_a_long_tail(spark):
    random.seed(3)
    check(spark, [0] * 500 + [random.randint(1, 50) for _ in range(400)] + [10**9, 10**9 + 1])
    check(spark, [7] * 40)
    check(spark, [-5, -5, 3, 10**12])


def test_quantiles_of_fractions_and_missing_values(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=999)
    df = spark.createDataFrame([(float(x), None) for x in a], "d1 double, d2 double")
    out = {r.measure: r for r in describe_measures(Fact(df, DEMO)).collect()}
    assert set(out) == {"d1"}
    assert out["d1"]["q1"] == pytest.approx(np.quantile(a, 0.25))
    assert out["d1"]["std"] == pytest.approx(np.std(a, ddof=1))


def test_correlation_of_a_constant_is_missing(spark):
    out = {(r.a, r.b): r.r for r in correlation(two_columns(spark, [1, 2, 4], [5, 5, 5])).collect()}
    assert out["d1", "d1"] == pytest.approx(1) and out["d1", "d2"] is None and out["d2", "d2"] is None
    a, b = [1, 2, 4, 9], [3, 1, 7, 2]
    got = {(r.a, r.b): r.r for r in correlation(two_columns(spark, a, b)).collect()}
    assert got["d1", "d2"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_report_holds_all_sections(spark):
    out = statistical_report(two_columns(spark, [1, 2, 4], [5, 6, 5]))
    counts = {r.section: r["count"] for r in out.groupBy("section").count().collect()}
    assert counts == {"describe": 14, "correlation": 4, "distribution": 1}


def test_quality_counts(spark):
    d = date(2025, 1, 1)
    demo = [(d, "A", "X", 1, 1, 1), (date(1990, 1, 1), "B", None, 2, -4, 1), (None, "C", "Y", None, 1, None)]
    facts = three(spark, demo, enrol=[(d, "A", "X", 1, 1, 1, 1)])
    report = quality_report(facts.demographic, date(2025, 1, 1), date(2025, 12, 31), [facts.enrolment])
    failed = {(r.check, r.column): (r.failed, r.total) for r in report.collect()}
    assert failed["missing", "date"] == (1, 3) and failed["missing", "district"] == (1, 3)
    assert failed["missing", "pincode"] == (1, 3) and failed["missing", "d2"] == (1, 3)
    assert failed["missing", "d1"] == (0, 3) and failed["date_range", "date"] == (1, 3)
    assert failed["negative", "d1"] == (1, 3) and failed["absent_in_enrol", "state"] == (2, 3)
    total = sum(t for _, t in failed.values())
    bad = sum(f for f, _ in failed.values())
    assert math.isclose(quality_score(report).first().score, 1 - bad / total, abs_tol=1e-6)
    assert report.filter(F.col("pass_rate") > 1).count() == 0
