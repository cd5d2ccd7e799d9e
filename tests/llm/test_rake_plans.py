import pytest

from tallymap.llm import mixing

from .test_mixing import raked

CELLS = "source string, lang string, topic int, tokens long"


def test_a_round_is_one_table_and_shares_its_joins(spark, monkeypatch):
    rows = [(s, g, t, 7 + 5 * i % 11 + 3 * t) for i, s in enumerate(["a", "b", None]) for g in ("x", "y", None) for t in range(3)][:-2]
    cells = mixing.staged(spark.createDataFrame(rows, CELLS), "cells")
    rounds = []
    monkeypatch.setattr(mixing, "staged", lambda df, name, put=mixing.staged: (rounds.append(df) if name == "factors" else None, put(df, name))[1])
    targets = {m: mixing.tempered(cells, m, 0.5) for m in mixing.MARGINS}
    out = mixing.rake(cells, targets, rounds=3, tolerance=0).collect()
    fitted, _ = raked(rows, 0.5, 3)
    assert len(out) == len(rows)
    assert all(r.fitted == pytest.approx(fitted[(r.source, r.lang, r.topic)], rel=1e-9) for r in out)
    assert len(rounds) == 3  # and not one for each margin of a round
    last = rounds[-1]
    last.collect()
    plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and "<=>" not in plan and "isnull(" not in plan  # joins on whole numbers


def test_no_cells_and_absent_targets(spark):
    cells = spark.createDataFrame([("a", "x", 9), (None, "y", 1)], "source string, lang string, tokens long")
    target = {"source": spark.createDataFrame([("a", 0.5), ("gone", 0.5)], "source string, target double")}
    assert mixing.rake(cells.limit(0), target).count() == 0
    found = {r.source: r.fitted for r in mixing.rake(cells, target).collect()}
    assert found[None] == pytest.approx(0.1 / 0.6) and found["a"] == pytest.approx(0.5 / 0.6)
