import random
from datetime import timedelta

import pytest

from tallymap import Fact, FactSet, FactSpec
from tallymap.plans import answers
from tests.frames import BIO, DAY0, DEMO, ENROL, three


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(2)

    def made(spec, days):
        return [
            (DAY0 + timedelta(d), s, f"{s}{i}", 100 * i + j, *[rng.randrange(1, 90) for _ in spec.measures])
            for d in range(days) for s in "AB" for i in range(3) for j in range(2)
        ]

    return three(spark, made(DEMO, 25), made(BIO, 12), made(ENROL, 20))


EXPECTED = {
    "overview": {"overview": 1},
    "state_analysis": {"demographic": 2, "enrollment": 2},
    "time_series": {"daily": 45, "forecast": 30},
    "clustering": {"clusters": 5, "top": None},
    "statistical_analysis": {"statistics": 2, "correlation": 4, "distribution": 2},
    "geographic_heatmap": {"heatmap": 6},
    "predictive_model": {"predictions": 7, "feature_importance": 3, "model_score": 1},
    "anomaly_detection": {"anomalies": None},
    "district_ranking": {"demographic": 6, "enrollment": 6},
    "drill_down": {"data": 2},
    "spike_detection": {"spikes": None, "summary": 1},
    "trend_analysis": {"daily": 25, "summary": 1},
    "cluster_insights": {"entities": 6, "clusters": 6, "top": 6, "quality": 1},
    "government_dashboard": {"kpis": 1, "performers": 4, "alerts": 0},
    "demographic_analysis": {"summary": 1, "top_states": 2, "top_districts": 6, "statistics": 2},
    "biometric_analysis": {"summary": 1, "top_states": 2, "top_districts": 6},
    "enrollment_analysis": {"summary": 1, "top_states": 2, "top_districts": 6},
    "recommendations": {"recommendations": None},
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_answer_frames(facts, name):
    got = getattr(answers, name)(facts)
    assert set(got) == set(EXPECTED[name])
    for part, n in EXPECTED[name].items():
        count = got[part].count()
        assert n is None or count == n, part


def test_filtered_answers(facts):
    got = answers.enrollment_analysis(facts, "A", "A1")
    summary = got["summary"].first()
    assert (summary.states, summary.districts, summary.pincodes) == (1, 1, 2)
    assert summary.rate > 0 and got["top_states"].count() == 0
    assert answers.demographic_analysis(facts, "nowhere")["summary"].count() == 0
    assert answers.predictive_model(facts, "nowhere") == {}
    assert answers.comparative_analysis(facts, ["B", "A"])["comparisons"].count() == 2
    assert answers.drill_down(facts, "A", "A1")["data"].count() == 2


def test_tables_must_share_their_keys(facts):
    other = FactSpec("bio", ("b1", "b2"), date_col="day")
    renamed = Fact(facts.biometric.df.withColumnRenamed("date", "day"), other)
    with pytest.raises(ValueError):
        FactSet(facts.demographic, renamed, facts.enrolment)
