import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, _lang string, _value int, rows string, mix_draw string, topic string"


def docs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        words = " ".join(f"w{rng.integers(60) + 60 * (i % 3)}" for _ in range(int(rng.integers(1, 60))))
        source = None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}"
        rows.append((i, words, ["en", "de", None][i % 3], source, "x", 1, "y", "z", "t"))
    rows += [rows[5], rows[5], (None, None, "en", "hot", "x", 1, "y", "z", "t"), (900, "", None, None, "x", 1, "y", "z", "t")]
    return spark.createDataFrame(rows, DOCS)


def raked(cells, power, rounds):
    """Plain raking of (margins..., tokens) to tempered shares."""
    keys, tokens = [c[:3] for c in cells], np.array([c[3] for c in cells], float)
    mass = tokens / tokens.sum()
    for _ in range(rounds):
        for at in range(3):
            values = {k[at] for k in keys}
            n = {v: sum(t for k, t in zip(keys, tokens, strict=True) if k[at] == v) ** power for v in values}
            share = {v: sum(m for k, m in zip(keys, mass, strict=True) if k[at] == v) for v in values}
            mass = np.array([m * n[k[at]] / sum(n.values()) / share[k[at]] for k, m in zip(keys, mass, strict=True)])
    return dict(zip(keys, mass / mass.sum(), strict=True)), tokens.sum()


def test_weights_and_draws_against_plain_raking(spark):
    frame = docs(spark)
    out = mixing.mix(frame, keep=0.4, power=0.5)
    assert out.columns == [
        *(c for c in frame.columns if c not in mixing.ADDED), "tokens", "topic", "mix_weight", "mix_residual", "mix_probability", "mix_kept",
    ]
    rows = out.collect()
    assert len(rows) == frame.count()
    cells = {}
    for r in rows:
        assert r.tokens == max(1, len((r.text or "").split())) and (r._lang, r._value, r.rows) == ("x", 1, "y")
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.tokens
    fitted, total = raked([(*k, n) for k, n in cells.items()], 0.5, 12)
    for r in rows:
        key = (r.source, r.lang, r.topic)
        assert r.mix_weight == pytest.approx(fitted[key] * total / cells[key], rel=1e-6)
    factor = max(r.mix_probability / r.mix_weight for r in rows)
    expected = sum(r.tokens * min(1, r.mix_weight * factor) for r in rows)
    assert 0.4 * total <= expected <= 0.4 * total * 1.02
    draws = {(r.doc_id, r.text): r.d for r in frame.select(
        "doc_id", "text", (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), F.lit(0)), F.lit(1 << 52)) / 2.0**52).alias("d")
    ).collect()}
    for r in rows:
        assert r.mix_kept == (draws[(r.doc_id, r.text)] < r.mix_probability)
    report = mixing.mixing_report(frame).collect()
    assert len(report) == len(rows) and len({r.mix_kept for r in report if r.doc_id == 5}) == 1


def test_targets_that_cannot_both_hold(spark):
    cells = spark.createDataFrame([("a", "x", 9), ("b", "y", 1)], "source string, lang string, tokens long")
    one = lambda column, pairs: spark.createDataFrame(pairs, f"{column} string, target double")
    both = {"source": one("source", [("a", 0.5), ("b", 0.5)]), "lang": one("lang", [("x", 0.9), ("y", 0.1)])}
    assert mixing.rake(cells, both).first().residual == pytest.approx(0.4, abs=1e-6)
    agree = {"source": both["source"], "lang": one("lang", [("x", 0.5), ("y", 0.5)])}
    assert mixing.rake(cells, agree).first().residual < 1e-9
    assert mixing.rake(cells.limit(0), agree).count() == 0


def test_one_measurement_of_every_text(spark):
    plan = mixing.mixing_report(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "text" not in plan
