"""Activity facts on the star-schema test tables.

state = region, district = nation, pincode = customer; order lines play the
demographic table, orders the biometric one and events the enrolments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.spec import Fact, FactSet, FactSpec

UPDATES = FactSpec("updates", ("upd_new", "upd_old"))
RENEWALS = FactSpec("renewals", ("ren_done", "ren_open"))
SIGNUPS = FactSpec("signups", ("sgn_first", "sgn_act", "sgn_look"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pincode, district, state.  Whether a side is broadcast is left to Spark's size check."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        table(spark, sf_dir, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("pincode"),
            F.col("n_name").alias("district"),
            F.col("r_name").alias("state"),
        )
    )


def _when(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(0)).cast("bigint")


def updates(spark: SparkSession, sf_dir: str) -> Fact:
    # Orders meet the geography first, so the order lines are shuffled once, on the order key.
    placed = table(spark, sf_dir, "orders").join(
        geography(spark, sf_dir), F.col("o_custkey") == F.col("pincode")
    )
    new = F.col("l_returnflag") == "N"
    quantity = F.col("l_quantity")
    df = (
        table(spark, sf_dir, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_shipdate").cast("date").alias("date"),
            "state", "district", "pincode",
            _when(new, quantity).alias("upd_new"),
            _when(~new, quantity).alias("upd_old"),
        )
    )
    return Fact(df, UPDATES)


def renewals(spark: SparkSession, sf_dir: str) -> Fact:
    done = F.col("o_orderstatus") == "F"
    amount = F.floor(F.col("o_totalprice") / 10000)
    df = (
        table(spark, sf_dir, "orders")
        .join(geography(spark, sf_dir), F.col("o_custkey") == F.col("pincode"))
        .select(
            F.col("o_orderdate").cast("date").alias("date"),
            "state", "district", "pincode",
            _when(done, amount).alias("ren_done"),
            _when(~done, amount).alias("ren_open"),
        )
    )
    return Fact(df, RENEWALS)


def signups(spark: SparkSession, sf_dir: str) -> Fact:
    kind = F.col("event_type")
    df = (
        table(spark, sf_dir, "events")
        .join(geography(spark, sf_dir), F.col("user_id") == F.col("pincode"))
        .select(
            F.col("ts").cast("date").alias("date"),
            "state", "district", "pincode",
            (kind == "signup").cast("bigint").alias("sgn_first"),
            kind.isin("click", "purchase").cast("bigint").alias("sgn_act"),
            kind.isin("view", "error").cast("bigint").alias("sgn_look"),
        )
    )
    return Fact(df, SIGNUPS)


def facts(spark: SparkSession, sf_dir: str) -> FactSet:
    return FactSet(updates(spark, sf_dir), renewals(spark, sf_dir), signups(spark, sf_dir))
