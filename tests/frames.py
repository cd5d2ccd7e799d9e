"""Literal fixture tables."""

from datetime import date, timedelta

from tallymap import Fact, FactSet, FactSpec

DAY0 = date(2025, 3, 1)
DEMO = FactSpec("demo", ("d1", "d2"))
BIO = FactSpec("bio", ("b1", "b2"))
ENROL = FactSpec("enrol", ("e1", "e2", "e3"))


def fact(spark, spec, rows):
    fields = "date date, state string, district string, pincode bigint, " + ", ".join(
        f"{m} bigint" for m in spec.measures
    )
    return Fact(spark.createDataFrame(rows, fields), spec)


def series(spark, totals, state="A", gap=1):
    """One region, one row per day."""
    rows = [(DAY0 + timedelta(days=i * gap), state, "D", 1, t, 0) for i, t in enumerate(totals)]
    return fact(spark, DEMO, rows)


def three(spark, demo, bio=(), enrol=()):
    return FactSet(
        fact(spark, DEMO, list(demo)), fact(spark, BIO, list(bio)), fact(spark, ENROL, list(enrol))
    )


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
