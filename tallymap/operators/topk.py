"""Top-k reports.  Ties go to the smaller key, so results are the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, by: str, k: int, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc(c) for c in keys]).limit(k)


def top_per_group(df: DataFrame, group: str, by: str, k: int, keys: Sequence[str]) -> DataFrame:
    """k best rows of each group.

    The rank filter lets Spark cut every partition to k rows per group before
    the shuffle, so a group holding most of the rows costs no more than others.
    """
    order = W.partitionBy(group).orderBy(F.desc(by), *[F.asc(c) for c in keys])
    ranked = df.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def top_bottom(df: DataFrame, keys: Sequence[str], by: str = "total", k: int = 5) -> DataFrame:
    """First and last k rows of the descending list."""
    last = df.orderBy(F.asc(by), *[F.desc(c) for c in keys]).limit(k)
    sides = top_k(df, by, k, keys).withColumn("side", F.lit("top")).unionByName(
        last.withColumn("side", F.lit("bottom"))
    )
    return sides.select("side", *[c for c in df.columns])
