import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.llm import hard_negatives
from tallymap.llm.hard_negatives import PRIMES, Settings, primes_for, residue_scores

SCHEMA = "vec_id long, embedding array<double>, label int, score long, rank string, block int"
ROWS = 260


def odd_rows():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((5, 12))
    rows = []
    for i in range(ROWS):
        v = centres[i % 5] + 0.4 * rng.standard_normal(12)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), i % 3))
    rows += [rows[10], rows[10], rows[20]]  # repeated rows, of an anchor too
    rows += [(1000 + i, rows[30][1], i % 2) for i in range(12)]  # ties
    rows += [(2000, [0.5, -0.25], 1), (2010, [], 2), (2020, [0.0] * 12, 0)]  # short, empty, zero
    rows += [(None, rows[0][1], 1), (3000, None, 1), (3010, rows[0][1], None), (3020, [1.0, None], 1)]
    rows += [(3030, [math.nan] * 12, 1), (3040, [math.inf] + [0.0] * 11, 1), (3050, [1e300] * 12, 1)]
    return [(*r, 1, "x", 2) for r in rows]


def brute(rows, settings, every):
    ok = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) > 1e6 for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        ok.append((i, [math.floor(x * 256) for x in v], label))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for at, (a, v, label) in enumerate(ok):
        if a % every:
            continue
        scored = [(-score(v, w), i, k, j) for j, (i, w, k) in enumerate(ok) if j != at]
        for negative_p, p, _, _ in sorted(s for s in scored if s[2] == label)[: settings.positives]:
            inside = [s for s in scored if s[2] != label and settings.low * -negative_p <= 100 * -s[0] <= settings.high * -negative_p]
            for rank, (negative_n, n, _, _) in enumerate(sorted(inside)[: settings.negatives], 1):
                out.append((a, p, rank, n, -negative_p, -negative_n))
    return sorted(out)


@pytest.mark.parametrize("settings", [Settings(), Settings(block_rows=16, anchor_rows=3, group_bytes=256, positives=2)])
def test_against_all_pairs(spark, settings):
    rows = odd_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hard_negatives.hard_negatives(hard_negatives.relabelled(frame), F.col("vec_id") % 10 == 0, settings)
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(rows, settings, 10)
    assert len(got) > 500


def test_exact_beyond_floats():
    rng = np.random.default_rng(8)
    a, b = rng.integers(-(2**24), 2**24, (9, 1500)), rng.integers(-(2**24), 2**24, (11, 1500))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a])
    largest = max(sum(int(x) ** 2 for x in r) for m in (a, b) for r in m)
    assert (residue_scores(a, b, primes_for(largest)) == want).all()
    edge = np.full((1, 1024), 125)
    assert residue_scores(edge, -edge, primes_for(125**2 * 1024))[0, 0] == -(125**2) * 1024
    assert residue_scores(a[:, :0], b[:, :0], PRIMES[:1]).tolist() == np.zeros((9, 11)).tolist()


def test_primes():
    assert all(p % d for p in PRIMES for d in range(2, 16))
    assert math.prod(primes_for(2.0**61)) > 2**62 and len(primes_for(0)) == 1
    assert (max(PRIMES) // 2) ** 2 * hard_negatives.SPAN < 2**24
    with pytest.raises(ValueError, match="fit a long"):
        primes_for(2.0**64)


def test_empty_and_lonely(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    one = spark.createDataFrame(odd_rows()[:1], SCHEMA)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.hard_negatives(one, F.lit(None).cast("boolean")).count() == 0
