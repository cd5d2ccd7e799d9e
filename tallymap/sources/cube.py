"""Saved daily cubes: the table to query when the fact tables are large."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.functions.columns import present
from tallymap.operators.rollup import daily_cube
from tallymap.spec import Fact, FactSpec

MONTH = "month_start"


def _ordered(fact: Fact) -> DataFrame:
    """The daily cube in ranges of dates and regions, which splits a day or region that holds most of the rows over
    several files and lets readers skip files and row groups."""
    keys = [fact.spec.date_col, *fact.spec.levels]
    return daily_cube(fact).df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def save_cube(fact: Fact, path: str) -> None:
    """Write the daily cube as Parquet, ordered by date and region."""
    _ordered(fact).write.parquet(path)


def open_cube(spark: SparkSession, spec: FactSpec, path: str) -> Fact:
    return Fact(spark.read.parquet(path), replace(spec, records_col="records"))


def save_monthly_cube(fact: Fact, path: str, append: bool = False) -> None:
    """The daily cube in a folder for each month (rows without a date have one of their own).

    With ``append`` new rows are added beside the old files, of which none is rewritten.  Rows of days
    that the cube has already are added to theirs: sums and counts are of both.
    """
    month = F.trunc(fact.spec.date_col, "month")
    rows = _ordered(fact).withColumn(MONTH, month)
    rows.write.mode("append" if append else "errorifexists").partitionBy(MONTH).parquet(path)


def open_monthly_cube(spark: SparkSession, spec: FactSpec, path: str) -> Fact:
    """The saved cube; questions about recent days read the folders of their months only."""
    frame = spark.read.parquet(path)
    frame = frame.withColumn(MONTH, F.col(MONTH).cast("date"))  # folder names are text where all are undated
    return Fact(frame, replace(spec, records_col="records", month_col=MONTH))


# --- sketches ------------------------------------------------------------------------------

#: Base two logarithm of a distinct-count sketch's buckets: 1.15 % standard error, 8 KB at most.
LG_BUCKETS = 13
#: Size of a quantile sketch: 0.83 % rank error for one quantile, some 10 KB for a billion values.
QUANTILE_SIZE = 400


def save_sketches(fact: Fact, path: str, by: Sequence[str] = ("state",), append: bool = False) -> None:
    """For each date and region: distinct-count sketches of the finer levels, quantile sketches of the measures.

    Sketches merge: any range of dates and any wider level is answered from these rows.  Taken from source rows, as a cube of sums
    has lost the single values.  Further days are appended as in ``save_monthly_cube``.
    """
    spec = fact.spec
    if spec.records_col:
        raise ValueError("sketches are taken from source rows, not from a cube")
    finer = [c for c in spec.levels if c not in by]
    sketches = [F.hll_sketch_agg(F.col(c), F.lit(LG_BUCKETS)).alias(f"{c}_distinct") for c in finer]
    sketches += [F.kll_sketch_agg_bigint(F.col(m), F.lit(QUANTILE_SIZE)).alias(f"{m}_values") for m in spec.measures]
    rows = present(fact.df, by).groupBy(spec.date_col, *by).agg(F.count(F.lit(1)).alias("records"), *sketches)
    month = F.trunc(spec.date_col, "month")
    rows.withColumn(MONTH, month).write.mode("append" if append else "errorifexists").partitionBy(MONTH).parquet(path)


def open_sketches(spark: SparkSession, path: str, first=None, last=None, date: str = "date") -> DataFrame:  # noqa: ANN001
    """The rows of ``save_sketches`` from the first to the last date, both included; files of other months are not read."""
    rows = spark.read.parquet(path)
    for bound, keep in ((first, Column.__ge__), (last, Column.__le__)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            rows = rows.where(keep(F.col(date), day) & keep(F.col(MONTH).cast("date"), F.trunc(day, "month")))
    return rows


def approx_coverage(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(regions, records, about how many distinct values of each finer level) from merged sketches."""
    levels = [c.removesuffix("_distinct") for c in sketches.columns if c.endswith("_distinct")]
    return sketches.groupBy(*by).agg(
        F.sum("records").alias("records"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{c}_distinct")).alias(f"{c}s") for c in levels],
    )


def approx_quantiles(
    sketches: DataFrame, by: Sequence[str] = (), probabilities: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """(regions, measure, probability, value): values whose rank is about that share of the source rows."""
    measures = [c.removesuffix("_values") for c in sketches.columns if c.endswith("_values")]
    merged = sketches.groupBy(*by).agg(*[F.kll_merge_agg_bigint(f"{m}_values").alias(m) for m in measures])
    cells = [
        F.struct(
            F.lit(m).alias("measure"), F.lit(p).alias("probability"),
            F.when(F.kll_sketch_get_n_bigint(m) > 0, F.kll_sketch_get_quantile_bigint(m, F.lit(p))).alias("value"),
        )
        for m in measures
        for p in probabilities
    ]
    return merged.select(*by, F.inline(F.array(*cells)))
