from pyspark.sql import functions as F

from tallymap.operators import stats


def test_an_extreme_value_leaves_ranges_small(spark):
    values = spark.range(10_000).union(spark.range(1).select(F.lit(10**15)))
    counts = stats.value_counts(values.toDF("x"), ["x"])
    largest = stats._placed(counts).groupBy("measure", "bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 400
    row = stats.describe_counts(counts, {"median": 0.5, "q1": 0.25}).first()
    assert (row.median, row.q1) == (5000.0, 2500.0)
