import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallymap import Fact
from tallymap.operators.filters import date_range, recent_activity
from tallymap.operators.rollup import coverage, daily_record_counts, daily_totals, rollup_by
from tallymap.sources import cube
from tests.frames import DEMO, fact, rows

START = date(2025, 1, 20)


def days(spark, n, pins=40, seed=1):
    draw = random.Random(seed)
    data = [
        (START + timedelta(days=i % n), f"S{i % 3}", f"D{i % 7}", draw.randrange(pins), draw.randrange(100), draw.randrange(50))
        for i in range(n * 12)
    ]
    return fact(spark, DEMO, [*data, (None, "S0", "D0", 1, 5, 5)])


def test_months_are_folders_and_recent_days_read_only_theirs(spark, tmp_path):
    path = str(tmp_path / "cube")
    f = days(spark, 100)
    cube.save_monthly_cube(f, path)
    months = sorted(d for d in os.listdir(path) if d.startswith(cube.MONTH))
    assert months == [f"{cube.MONTH}=2025-0{m}-01" for m in (1, 2, 3, 4)] + [f"{cube.MONTH}=__HIVE_DEFAULT_PARTITION__"]
    saved = cube.open_monthly_cube(spark, DEMO, path)
    recent = recent_activity(saved, days=20)
    folders = {r[0].split(cube.MONTH + "=")[1][:10] for r in recent.df.select(F.col("_metadata.file_path")).distinct().collect()}
    assert folders == {"2025-04-01"}
    plan = recent.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_start" in plan and "2025-04-01" in plan
    assert rows(rollup_by(recent, ["state"]), "state") == rows(rollup_by(recent_activity(f, days=20), ["state"]), "state")
    for ask in (daily_totals, daily_record_counts, lambda x: rollup_by(date_range(x, 45), ["district"])):
        assert sorted(rows(ask(saved)), key=repr) == sorted(rows(ask(f)), key=repr)


def test_appended_equals_rebuilt_and_nothing_is_rewritten(spark, tmp_path):
    path = str(tmp_path / "cube")
    f = days(spark, 100)
    early = F.col("date").isNull() | (F.col("date") < date(2025, 3, 10))
    cube.save_monthly_cube(f.on(f.df.where(early)), path)
    before = {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}
    cube.save_monthly_cube(f.on(f.df.where(~early)), path, append=True)
    assert all(os.path.getmtime(n) == t for n, t in before.items())
    saved = cube.open_monthly_cube(spark, DEMO, path)
    for keys in (["date"], ["state"], ["state", "district"], ["pincode"]):
        assert rows(rollup_by(saved, keys), *keys) == rows(rollup_by(f, keys), *keys)
    assert rows(daily_record_counts(saved), "date") == rows(daily_record_counts(f), "date")
    with pytest.raises(Exception):  # without append an existing cube is left alone
        cube.save_monthly_cube(f, path)


def test_distinct_counts_of_any_dates_and_level(spark, tmp_path):
    path = str(tmp_path / "sketches")
    f = days(spark, 90, pins=20_000)
    cube.save_sketches(f.on(f.df.where(F.col("date") < date(2025, 3, 1))), path)
    cube.save_sketches(f.on(f.df.where(~(F.col("date") < date(2025, 3, 1)))), path, append=True)
    first, last = date(2025, 2, 3), date(2025, 3, 20)
    part = f.on(f.df.where(F.col("date").between(first, last)))
    opened = cube.open_sketches(spark, path, first, last)
    assert "PartitionFilters: [isnotnull(month_start" in opened._jdf.queryExecution().executedPlan().toString()
    for by in ([], ["state"]):
        exact = rows(coverage(part, by), *by)
        about = rows(cube.approx_coverage(opened, by), *by)
        assert [r[len(by)] for r in about] == [r[len(by)] for r in rows(part.df.groupBy(*by).count(), *by)]
        for e, a in zip(exact, about, strict=True):
            assert a[-1] == pytest.approx(e[-1], rel=0.03) and a[-2] == e[-2]


def test_quantiles_of_single_records(spark, tmp_path):
    path = str(tmp_path / "sketches")
    f = days(spark, 60)
    cube.save_sketches(f, path)
    found = cube.approx_quantiles(cube.open_sketches(spark, path), ["state"], (0.1, 0.5, 0.95))
    values = {}
    for r in f.df.collect():
        for m in DEMO.measures:
            values.setdefault((r.state, m), []).append(r[m])
    assert found.count() == 3 * 2 * 3
    for r in found.collect():
        known = values[(r.state, r.measure)]
        below, upto = sum(v < r.value for v in known), sum(v <= r.value for v in known)
        assert below <= (r.probability + 0.02) * len(known) + 1 and upto >= (r.probability - 0.02) * len(known) - 1


def test_empty_and_null_measures(spark, tmp_path):
    cube.save_sketches(fact(spark, DEMO, [(START, "S", "D", 1, None, 3), (None, "S", "D", None, None, 4), (START, None, "D", 1, 1, 1)]), str(tmp_path / "a"))
    opened = cube.open_sketches(spark, str(tmp_path / "a"))
    assert rows(cube.approx_coverage(opened, ["state"])) == [("S", 2, 1, 1)]
    assert {(r.measure, r.value) for r in cube.approx_quantiles(opened, probabilities=[0.0, 1.0]).collect()} == {
        ("d1", None), ("d2", 3), ("d2", 4)}
    with pytest.raises(ValueError, match="source rows"):
        cube.save_sketches(Fact(opened, cube.open_cube(spark, DEMO, str(tmp_path / "a")).spec), str(tmp_path / "b"))
