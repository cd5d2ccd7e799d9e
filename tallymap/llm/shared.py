"""What several operators use: staged tables, row digests, connected components, corpus folds."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.sources.scratch import shared_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: computed once, safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which gives freed memory back when it ends: an idle worker of one stage would keep it from the next."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def few_rows(batches: Iterator[pa.RecordBatch], n: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``n`` rows, so that a task holds little of what it makes besides what it was sent."""
    for batch in batches:
        for start in range(0, batch.num_rows, n):
            yield batch.slice(start, n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def digest16(value):
    """128 bits that stand for a text."""
    return F.unhex(F.substring(F.sha2(value.cast("binary"), 256), 1, 32))


def id_fold(doc_id, parts: int):
    """crc32 of the id's text, modulo ``parts``; rows without an id are in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts), F.lit(-1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (node, root) for every node of a link.

    Large-star and small-star steps: each links nodes to the smallest neighbour,
    until only stars are left.  A hub's links meet its minimum in a join whose
    partitions adaptive execution can split; the minima are combined before the
    shuffle.  Every step is a table in the shared folder.
    """
    links = staged(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = staged(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = staged(small, "small-star")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
