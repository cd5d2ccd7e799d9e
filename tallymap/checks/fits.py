"""What must hold for any fit: clusters next to sums and counts that SQL can state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.checks.base import SGN, UPD, UPD_SUMS, big, query, through_csv
from tallymap.checks.models import FEATURE_SQL, FEATURES, FIRST, SECOND
from tallymap.operators import cluster
from tallymap.sources import csv_parts, exports, fixtures

TOTALS = ", ".join(big(c, c) for c in FEATURES)


def _whole(amount: Column, name: str) -> Column:
    return F.round(F.sum(amount)).cast("bigint").alias(name)


@query(
    f"SELECT COUNT(*) AS districts, least(6, COUNT(*)) AS clusters, TRUE AS one_category, {TOTALS} FROM feat",
    **FEATURE_SQL,
)
def export_clusters_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every district is exported once with its sums, and all of a cluster with one category."""
    rows = through_csv(exports.export_clusters(fixtures.facts(spark, sf_dir)), "clusters")
    one = F.count_distinct("cluster") == F.count_distinct("cluster", "cluster_category")
    return rows.agg(
        F.count_distinct("state", "district").alias("districts"),
        F.count_distinct("cluster").alias("clusters"),
        one.alias("one_category"),
        *[_whole(F.col(c), c) for c in FEATURES],
    )


@query(
    f"SELECT COUNT(*) AS pincodes, least(5, COUNT(*)) AS clusters, {UPD_SUMS} FROM p",
    p=f"SELECT pincode, {UPD_SUMS} FROM updates GROUP BY pincode",
)
def kmeans_pincodes_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres times sizes are the sums of the table."""
    fact = fixtures.updates(spark, sf_dir)
    centres = cluster.cluster_centers(cluster.kmeans_pincodes(fact), fact.spec.measures)
    sums = [_whole(F.col(f"center_{m}") * F.col("size"), m) for m in fact.spec.measures]
    return centres.agg(F.sum("size").alias("pincodes"), F.count(F.lit(1)).alias("clusters"), *sums)


@query(
    f"""SELECT COUNT(*) AS districts, least(6, COUNT(*)) AS clusters, {big(" + ".join(FIRST), 'demographic')},
               {big(" + ".join(SECOND), 'enrolment')}, TRUE AS top_is_whole, TRUE AS scores_in_range FROM feat""",
    **FEATURE_SQL,
)
def cluster_report_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means times sizes are the sums, the five largest of each cluster are there, scores are in their ranges."""
    report = cluster.cluster_report(fixtures.facts(spark, sf_dir))
    size = F.col("size")
    summed = report["clusters"].agg(
        F.sum("size").alias("districts"),
        F.count(F.lit(1)).alias("clusters"),
        _whole(size * F.col("avg_demographic"), "demographic"),
        _whole(size * F.col("avg_enrollment"), "enrolment"),
        F.sum(F.least(size, F.lit(5))).alias("listed"),
    )
    top = report["top"].select(F.count(F.lit(1))).scalar()
    score = report["quality"].select(F.struct("silhouette", "davies_bouldin")).scalar()
    in_range = score["silhouette"].between(-1, 1) & (score["davies_bouldin"] >= 0)
    return summed.select(
        "districts", "clusters", "demographic", "enrolment",
        (F.col("listed") == top).alias("top_is_whole"), in_range.alias("scores_in_range"),
    )


@query(
    f"""
    SELECT 'updates' AS dataset, state, COUNT(*) AS records, {big(UPD, 'total')} FROM updates GROUP BY state
    UNION ALL SELECT 'renewals', state, COUNT(*), CAST(SUM(ren_done + ren_open) AS BIGINT) FROM renewals GROUP BY state
    UNION ALL SELECT 'signups', state, COUNT(*), {big(SGN, 'total')} FROM signups GROUP BY state"""
)
def load_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_parts.load_summary_rows(fixtures.facts(spark, sf_dir))
