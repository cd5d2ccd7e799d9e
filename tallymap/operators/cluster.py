"""Clustering of regions and measures of cluster quality.

All of this runs on aggregated entities.  Centroids are k rows; they reach the
entities as scalar subqueries, so no join and no broadcast hint is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tallymap.functions.columns import total
from tallymap.functions.shape import align
from tallymap.operators.filters import filter_region
from tallymap.operators.joins import entity_features
from tallymap.operators.rollup import pincode_features
from tallymap.operators.topk import top_per_group
from tallymap.sources.scratch import stage
from tallymap.spec import Fact, FactSet

# Categories of clusters and labels of their quality.
HIGH, GROWING, STABLE = "High Activity", "Growing Region", "Stable Region"
GOOD, FAIR, POOR = "Good", "Fair", "Needs Improvement"

# Entities per task of a k-means iteration, and per block of the silhouette (a block is
# some hundred kilobytes; larger blocks mean fewer copies of each entity).
ROWS_PER_TASK = 100_000
BLOCK_ROWS = 5_000


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Adds ``<col>_z``: centred, divided by the population deviation (1 where that is 0)."""
    parts = [F.avg(c).alias(f"{c}_mean") for c in cols] + [
        F.stddev_pop(c).alias(f"{c}_sd") for c in cols
    ]
    stats = df.agg(F.struct(*parts).alias("stats")).scalar()

    def scaled(c: str) -> Column:
        sd = stats[f"{c}_sd"]
        return (F.col(c) - stats[f"{c}_mean"]) / F.when(sd == 0, 1.0).otherwise(sd)

    return df.withColumns({f"{c}_z": scaled(c) for c in cols})


def _best_model(
    points: DataFrame, k: int, seeds: Sequence[int], parallelism: int = 10
) -> KMeansModel:
    """k-means has several local optima: fit once per seed, keep the tightest.

    A fit is a row of short jobs, so some fits run side by side.
    """
    # Stop when the squared moves of all centres add up to less than 1e-4 (unit variance data).
    tol = (1e-4 / k) ** 0.5

    def fit(seed: int) -> KMeansModel:
        return KMeans(k=k, seed=seed, maxIter=300, tol=tol).fit(points)

    points.persist()
    try:
        with ThreadPool(min(parallelism, len(seeds))) as pool:
            fits = pool.map(inheritable_thread_target(points.sparkSession)(fit), seeds)
    finally:
        points.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def _by_activity(df: DataFrame, amount: Column) -> DataFrame:
    """Number the clusters by mean amount, largest first (fitted numbers are arbitrary)."""
    means = df.groupBy("cluster").agg(F.avg(amount).alias("mean"))
    ordered = means.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(-F.col("mean"), "cluster"))), lambda e: e["cluster"]
        ).alias("clusters")
    )
    rank = F.array_position(ordered.scalar(), F.col("cluster")) - 1
    return df.withColumn("cluster", rank.cast("int"))


def kmeans_entities(
    df: DataFrame, cols: Sequence[str], k: int = 6, restarts: int = 10, seed: int = 42
) -> DataFrame:
    """Adds ``cluster``, largest mean total first.  Fewer than two entities give no rows."""
    scaled = [f"{c}_z" for c in cols]
    entities = stage(standardize(df, cols))
    n = entities.count()
    if n < 2:
        return entities.drop(*scaled).withColumn("cluster", F.lit(None).cast("int")).limit(0)
    points = VectorAssembler(inputCols=scaled, outputCol="features").transform(entities)
    # Few entities in many small partitions would make every iteration wait on task starts.  Starting
    # centres are drawn per partition, so rows are dealt and ordered by value, not by file layout.
    packed = points.repartition(-(-n // ROWS_PER_TASK), *df.columns).sortWithinPartitions(*df.columns)
    model = _best_model(packed, min(k, n), range(seed, seed + restarts))
    assigned = model.transform(points).withColumnRenamed("prediction", "cluster")
    return _by_activity(assigned.drop("features", *scaled), total(cols))


def kmeans_pincodes(fact: Fact, k: int = 5) -> DataFrame:
    """Finest regions with their cluster."""
    return kmeans_entities(pincode_features(fact), fact.spec.measures, k)


def cluster_centers(assigned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Size and centre of each cluster in the original units."""
    return assigned.groupBy("cluster").agg(
        *[F.avg(c).alias(f"center_{c}") for c in cols], F.count(F.lit(1)).alias("size")
    )


def _sum_of_means(cols: Sequence[str]) -> Column:
    return sum((F.avg(c) for c in cols[1:]), start=F.avg(cols[0]))


def cluster_profile(
    assigned: DataFrame,
    first: Sequence[str],
    second: Sequence[str],
    variant: str = "report",
    texts: DataFrame | None = None,
) -> DataFrame:
    """Size, mean activity and category of each cluster.

    ``report`` asks for 20 % above the overall mean; ``export`` for any excess,
    and looks at the first measure of the second table only.  ``texts`` is a table with a
    ``category`` column and what is to be said about it.
    """
    factor = {"report": 1.2, "export": 1.0}[variant]
    growth_cols = list(second) if variant == "report" else list(second[:1])
    overall = assigned.agg(
        F.struct(
            _sum_of_means(list(first)).alias("demo"), _sum_of_means(growth_cols).alias("growth")
        ).alias("overall")
    ).scalar()
    means = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        _sum_of_means(list(first)).alias("avg_demographic"),
        _sum_of_means(list(second)).alias("avg_enrollment"),
        _sum_of_means(growth_cols).alias("growth"),
    )
    category = (
        F.when(F.col("avg_demographic") > overall["demo"] * factor, HIGH)
        .when(F.col("growth") > overall["growth"] * factor, GROWING)
        .otherwise(STABLE)
    )
    named = means.withColumn("category", category).drop("growth")
    return named if texts is None else named.join(texts, "category", "left")


def cluster_top(assigned: DataFrame, by: str, keys: Sequence[str], k: int = 5) -> DataFrame:
    return top_per_group(assigned, "cluster", by, k, keys)


def cluster_bubbles(profile: DataFrame) -> DataFrame:
    return profile.select(
        "cluster",
        F.col("avg_demographic").alias("x"),
        F.col("avg_enrollment").alias("y"),
        (F.sqrt("size") * 2).alias("r"),
    )


def _point(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def _needed(df: DataFrame, cols: Sequence[str], cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """The quality measures read their input several times, so it is computed once."""
    return stage(df.select(*keys, F.col(cluster).alias("cluster"), *cols))


def davies_bouldin(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance; one row."""
    return _davies_bouldin(_needed(df, cols, cluster), cols)


def _davies_bouldin(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    centers = df.groupBy(cluster).agg(F.array(*[F.avg(c) for c in cols]).alias("center"))
    by_cluster = centers.agg(
        F.map_from_entries(F.collect_list(F.struct(cluster, "center"))).alias("centers")
    ).scalar()
    own = F.element_at(by_cluster, F.col(cluster))
    squares = [(F.col(c) - own[i]) * (F.col(c) - own[i]) for i, c in enumerate(cols)]
    to_center = F.sqrt(sum(squares[1:], start=squares[0]))
    spread = df.groupBy(cluster).agg(F.avg(to_center).alias("s"))
    rows = spread.select(
        F.struct(F.col(cluster).alias("c"), "s", own.alias("p")).alias("row")
    ).agg(F.collect_list("row").alias("rows"))

    def worst(x: Column) -> Column:
        rest = F.filter("rows", lambda y: y["c"] != x["c"])

        def score(y: Column) -> Column:
            gap = _distance(x["p"], y["p"])
            return F.when(gap == 0, 0.0).otherwise((x["s"] + y["s"]) / F.nullif(gap, F.lit(0.0)))

        return F.array_max(F.transform(rest, score))

    k = F.size("rows")
    mean = F.aggregate(F.transform("rows", worst), F.lit(0.0), lambda acc, x: acc + x) / F.nullif(k, F.lit(0))
    return rows.select(F.when(k >= 2, mean).alias("davies_bouldin"))


def silhouette_samples(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    cluster: str = "cluster",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact Euclidean silhouette of each entity.

    The work is quadratic by definition.  Entities are cut into blocks of about
    ``block_rows`` and each task compares one block with one other, returning
    distance sums per entity and cluster only: pairs are never rows, a task
    holds two blocks, and a large cluster is spread over as many blocks as it
    fills.
    """
    return _silhouette_samples(_needed(df, cols, cluster, keys), keys, cols, block_rows)


def _silhouette_samples(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    blocks = df.agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("n")
    ).scalar()
    points = df.select(
        *keys,
        F.col("cluster").cast("int").alias("cluster"),
        _point(cols).alias("point"),
        blocks.alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64(*keys), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = points.select(*keys, "cluster", "point", F.col("block").alias("a"), other.alias("b"))
    right = points.select(
        F.col("cluster").alias("label"), F.col("point").alias("at"), other.alias("a"), F.col("block").alias("b")
    )
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        key_fields
        + [
            T.StructField("cluster", T.IntegerType()),
            T.StructField("other", T.IntegerType()),
            T.StructField("dist", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )

    def compare(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(there):
            x = np.stack(here["point"].to_numpy())
            labels = there["label"].to_numpy()
            for label in np.unique(labels):
                y = np.stack(there["at"].to_numpy()[labels == label])
                sums = np.zeros(len(x))
                for at in range(0, len(y), 64):  # some megabytes of differences at a time
                    gap = x[:, None, :] - y[None, at : at + 64, :]
                    sums += np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)).sum(axis=1)
                out.append(here[[*keys, "cluster"]].assign(other=label, dist=sums, n=len(y)))
        if not out:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.concat(out, ignore_index=True)

    partial = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, schema)
    sums = partial.groupBy(*keys, "cluster", "other").agg(
        F.sum("dist").alias("dist"), F.sum("n").alias("n")
    )
    same = F.col("other") == F.col("cluster")
    near = sums.groupBy(*keys, "cluster").agg(
        F.max(F.when(same, F.col("n"))).alias("size"),
        F.max(F.when(same, F.col("dist") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~same, F.col("dist") / F.col("n"))).alias("b"),
    )
    widest = F.nullif(F.greatest("a", "b"), F.lit(0.0))
    value = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / widest, F.lit(0.0))
    )
    return near.select(*keys, "cluster", value.alias("silhouette"))


def silhouette(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    cluster: str = "cluster",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean silhouette; NULL unless there are at least 2 clusters and fewer than entities."""
    return _mean_silhouette(silhouette_samples(df, keys, cols, cluster, block_rows))


def _mean_silhouette(samples: DataFrame) -> DataFrame:
    labels = F.count_distinct("cluster")
    usable = (labels >= 2) & (labels < F.count(F.lit(1)))
    return samples.agg(F.when(usable, F.avg("silhouette")).alias("silhouette"))


def silhouette_squared(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette over squared distances, one row; NULL where :func:`silhouette` is.

    The mean squared distance from an entity to a cluster is its squared distance to the centre
    plus the cluster's variance, so the work is linear in the entities: only one row
    per cluster meets them.
    """
    return _silhouette_squared(_needed(df, cols, cluster), cols)


def _silhouette_squared(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    spreads = [F.var_pop(c) for c in cols]
    by_cluster = df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("center"),
        sum(spreads[1:], start=spreads[0]).alias("spread"),
    )
    clusters = by_cluster.agg(F.collect_list(F.struct("cluster", "n", "center", "spread")).alias("rows")).scalar()
    scored = df.select("cluster", _point(cols).alias("point"), clusters.alias("clusters"))

    def gap(c: Column) -> Column:
        squares = F.zip_with("point", c["center"], lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) + c["spread"]

    own = F.get(F.filter("clusters", lambda c: c["cluster"] == F.col("cluster")), F.lit(0))
    a = gap(own) * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("clusters", lambda c: c["cluster"] != F.col("cluster")), gap))
    value = F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))
    return _mean_silhouette(
        scored.select("cluster", F.when(own["n"] == 1, 0.0).otherwise(value).alias("silhouette"))
    )


def quality_label(score: Column) -> Column:
    return F.when(score > 0.5, GOOD).when(score > 0.25, FAIR).otherwise(POOR)


def cluster_quality(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], cluster: str = "cluster", squared: bool = False
) -> DataFrame:
    """Both quality measures and the label, one row.

    ``squared`` takes the silhouette over squared distances, which is linear in the entities;
    the exact Euclidean one compares all of them and is meant for districts.
    """
    points = _needed(df, cols, cluster, keys)
    if squared:
        mean = _silhouette_squared(points, cols)
    else:
        mean = _mean_silhouette(_silhouette_samples(points, keys, cols))
    usable = F.col("silhouette").isNotNull()
    return align([mean,_davies_bouldin(points, cols)]).select(
        "silhouette",
        F.when(usable, F.col("davies_bouldin")).alias("davies_bouldin"),
        quality_label(F.col("silhouette")).alias("quality"),
    )


def cluster_report(
    facts: FactSet, state: str | None = None, district: str | None = None, k: int = 6
) -> dict[str, DataFrame]:
    """Clusters of districts, or of finest regions when one district is selected."""
    demo = filter_region(facts.demographic, state, district)
    enrol = filter_region(facts.enrolment, state, district)
    *above, fine = demo.spec.levels
    grain = fine if district else "district"
    keys = [*above, fine] if district else above
    cols = [*demo.spec.measures, *enrol.spec.measures]
    assigned = stage(kmeans_entities(entity_features(demo, enrol, grain), cols, k))
    scaled = standardize(assigned, cols)
    return {
        "entities": assigned,
        "clusters": cluster_profile(assigned, demo.spec.measures, enrol.spec.measures),
        "top": cluster_top(assigned, cols[0], keys),
        "quality": cluster_quality(scaled, keys, [f"{c}_z" for c in cols]),
    }


def clusters_with_category(facts: FactSet, k: int = 6) -> DataFrame:
    """All districts with measures, cluster and the category of the export variant."""
    cols = [*facts.demographic.spec.measures, *facts.enrolment.spec.measures]
    entities = entity_features(facts.demographic, facts.enrolment)
    assigned = stage(kmeans_entities(entities, cols, k))
    profile = cluster_profile(
        assigned, facts.demographic.spec.measures, facts.enrolment.spec.measures, "export"
    )
    categories = profile.select("cluster", F.col("category").alias("cluster_category"))
    return assigned.join(F.broadcast(categories), "cluster")  # k rows
