"""Regions named by several levels."""

import random
from datetime import timedelta

from tallymap.operators.anomaly import spike_detection
from tallymap.plans.dashboard import region_report
from tallymap.plans.profile import compare_entities
from tests.frames import DAY0, DEMO, fact, rows, three

DRAW = random.Random(2)


def history(state, district, pincode, base, spike=None):
    return [
        (DAY0 + timedelta(days=i), state, district, pincode, base * (9 if i == spike else 1) + DRAW.randrange(3), 1) for i in range(20)
    ]


A = history("Bihar", "Aurangabad", 1, 100, spike=15)
B = history("Maharashtra", "Aurangabad", 2, 1000)
C = history("Goa", "North", 3, 50)
BOTH = ("state", "district")


def test_spikes_of_one_name_stay_apart(spark):
    together = spike_detection(fact(spark, DEMO, A + B + C), "district")
    assert "Aurangabad" not in {r.district for r in together.collect() if r.value < 1000}
    apart = spike_detection(fact(spark, DEMO, A + B + C), BOTH)
    alone = spike_detection(fact(spark, DEMO, A), "district")
    assert [c for c in apart.columns if c in BOTH] == list(BOTH)
    assert [r[0:1] + r[2:] for r in rows(apart, "date") if r[1] == "Bihar"] == rows(alone, "date")
    assert (DAY0 + timedelta(days=15), "Bihar") in {(r.date, r.state) for r in apart.collect()}


def test_comparison_of_one_name(spark):
    wanted = [("Maharashtra", "Aurangabad"), ("Bihar", "Aurangabad"), ("Goa", "Aurangabad"), ("Bihar", "Aurangabad")]
    found = compare_entities(three(spark, A + B + C), BOTH, wanted).collect()
    total = lambda h: sum(r[4] + r[5] for r in h)
    assert [(r.ord, r.entity, r.total_demographic) for r in found] == [
        (0, "Maharashtra/Aurangabad", total(B)), (1, "Bihar/Aurangabad", total(A)), (3, "Bihar/Aurangabad", total(A)),
    ]
    assert {r.pincodes for r in found} == {1} and {r.districts for r in found} == {None}


def test_report_of_one_name(spark):
    enrol = [(d, s, t, p, n, 0, 0) for d, s, t, p, n, _ in A + B]
    found = {r.name: r for r in region_report(three(spark, A + B, enrol=enrol), BOTH).collect()}
    assert set(found) == {"Bihar/Aurangabad", "Maharashtra/Aurangabad"}
    assert {r.level for r in found.values()} == {"state/district"}
    assert found["Bihar/Aurangabad"].total_enrollments == sum(r[4] for r in A)
