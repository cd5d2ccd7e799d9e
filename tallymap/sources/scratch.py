"""Shared folder for checkpoints and intermediate files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session in ``spark.checkpoint.dir``.

    Only where it is unset on a single machine (tests) a fresh local folder is
    made and kept for the session; a cluster has to name one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallymap-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame as a table in the shared folder.

    Iterative fits and quality measures read an aggregated frame many times: it
    is computed once, does not depend on an executor staying alive, and its
    size is known to the planner afterwards.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
