import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.operators import stats
from tests.frames import DAY0, DEMO, fact, series

QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75, "top": 0.999}


def frame(spark, columns):
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names)), names


@pytest.mark.parametrize("most", [2, 5, 64, 4096])
def test_quantiles_against_numpy(spark, most):
    rng = random.Random(most)
    columns = {
        "ties": [rng.randrange(4) for _ in range(300)],
        "signed": [rng.randrange(-(10**6), 10**6) for _ in range(300)],
        "far": [10**12 if i == 7 else i for i in range(300)],
        "edges": [(-(2**63), 2**63 - 1)[i % 2] if i < 4 else i for i in range(300)],
        "one": [5] * 300,
        "gaps": [None if i % 3 else i for i in range(300)],
    }
    df, names = frame(spark, columns)
    rows = {r.measure: r for r in stats.refined_describe(stats.value_counts(df, names), QUARTILES, most).collect()}
    assert set(rows) == set(names)
    for name, values in columns.items():
        known = sorted(v for v in values if v is not None)
        r = rows[name]
        assert (r["min"], r["max"]) == (known[0], known[-1])
        # A mean is a double: it is exact against the largest value, not against what is left of opposite ones.
        assert r["mean"] == pytest.approx(sum(known) / len(known), rel=1e-9, abs=1e-12 * max(map(abs, known)))
        assert r["std"] == pytest.approx(statistics.stdev(known), rel=1e-9)
        for q, p in QUARTILES.items():
            rank = (len(known) - 1) * p
            low, high = known[math.floor(rank)], known[math.ceil(rank)]
            assert r[q] == float(low + (high - low) * (rank - math.floor(rank)))


def test_no_window_holds_more_than_the_bound(spark):
    """One value of 10^12 among 10^6 others: what a pass orders are the parts it cuts ranges into."""
    values = spark.range(1_000_000).union(spark.range(1).select(F.lit(10**12)))
    counts = stats.value_counts(values.toDF("x"), ["x"])
    row = stats.refined_describe(counts, {"median": 0.5, "q1": 0.25}, most=1000).first()
    assert (row.median, row.q1, row.max) == (500_000.0, 250_000.0, 10**12)
    found, ranges, sizes = {}, {("x", 0, 10**12, 0)}, []
    wanted = {("x", 500_000), ("x", 250_000)}
    while len(found) < 2:
        sizes.append(len(ranges))
        ranges = stats._refined(counts, ranges, wanted - found.keys(), 1000, found)
    assert found == {("x", 500_000): 500_000, ("x", 250_000): 250_000}
    assert len(sizes) <= 4 and max(sizes) <= 2


def test_empty_and_missing(spark):
    df, names = frame(spark, {"a": [None, None], "b": [3, None]})
    rows = stats.refined_describe(stats.value_counts(df, names), QUARTILES).collect()
    assert [(r.measure, r.median, r.std) for r in rows] == [("b", 3.0, None)]
    assert stats.refined_describe(stats.value_counts(df.limit(0), names), QUARTILES).count() == 0


def test_bounded_equals_describe(spark):
    f = series(spark, [random.Random(3).randrange(1000) for _ in range(200)])
    key = lambda df: sorted(tuple(r[c] for c in ("measure", "min", "max", "median", "q1", "q3")) for r in df.collect())
    assert key(stats.describe_bounded(f, 16)) == key(stats.describe_measures(f))


def test_report_reads_the_table_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(DAY0, f"S{i % 13}" if i % 17 else None, "D", i, int(rng.integers(9)), None if i % 5 else int(rng.integers(9))) for i in range(400)]
    fact(spark, DEMO, rows).df.write.parquet(str(tmp_path / "facts"))
    stored = fact(spark, DEMO, []).on(spark.read.parquet(str(tmp_path / "facts")))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(stats.report_fold(stored)).count("FileScan") == 1
    report = stats.statistical_report(stored)
    assert str(tmp_path) not in plan(report)
    got = {(r.section, r.item, r.statistic): r.value for r in report.collect()}
    for r in stats.correlation(stored).collect():
        assert got[("correlation", r.a, r.b)] == pytest.approx(r.r, abs=1e-12)
    for r in stats.describe_measures(stored).collect():
        assert got[("describe", r.measure, "median")] == r.median
    counts = {k[1]: v for k, v in got.items() if k[0] == "distribution"}
    assert len(counts) == 10 and None not in counts
    assert counts["S1"] == sum(1 for r in rows if r[1] == "S1")
