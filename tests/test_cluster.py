import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymap.operators import cluster
from tests.frames import DAY0, three

COLS = ["x", "y"]


def points(spark, n, k, seed=0):
    rng = np.random.default_rng(seed)
    labels = [i % k for i in range(n)]
    data = [(i, float(rng.normal(5 * l)), float(rng.normal(l)), l) for i, l in enumerate(labels)]
    return spark.createDataFrame(data, "id int, x double, y double, cluster int"), data


def silhouette_by_hand(data):
    p = np.array([(d[1], d[2]) for d in data])
    labels = np.array([d[3] for d in data])
    dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    out = []
    for i, l in enumerate(labels):
        own = labels == l
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = dist[i][own].sum() / (own.sum() - 1)
        b = min(dist[i][labels == m].mean() for m in set(labels) if m != l)
        out.append((b - a) / max(a, b))
    return out


def davies_bouldin_by_hand(data):
    p = np.array([(d[1], d[2]) for d in data])
    labels = np.array([d[3] for d in data])
    names = sorted(set(labels))
    c = [p[labels == m].mean(0) for m in names]
    s = [np.linalg.norm(p[labels == m] - c[i], axis=1).mean() for i, m in enumerate(names)]
    k = range(len(names))
    return np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in k if j != i) for i in k])


@pytest.mark.parametrize("n,k,block", [(40, 3, 2000), (40, 3, 7), (90, 5, 16), (7, 6, 3)])
def test_silhouette_equals_all_distances(spark, n, k, block):
    df, data = points(spark, n, k)
    got = cluster.silhouette_samples(df, ["id"], COLS, block_rows=block).orderBy("id").collect()
    assert [r.silhouette for r in got] == pytest.approx(silhouette_by_hand(data))
    mean = cluster.silhouette(df, ["id"], COLS, block_rows=block).first().silhouette
    assert mean == pytest.approx(np.mean(silhouette_by_hand(data))) and -1 <= mean <= 1


@pytest.mark.parametrize("n,k", [(40, 3), (90, 5), (7, 6)])
def test_squared_silhouette_equals_all_squared_distances(spark, n, k):
    df, data = points(spark, n, k)
    p = np.array([(d[1], d[2]) for d in data])
    labels = np.array([d[3] for d in data])
    dist = ((p[:, None] - p[None]) ** 2).sum(-1)
    want = []
    for i, l in enumerate(labels):
        own = labels == l
        a = dist[i][own].sum() / max(own.sum() - 1, 1)
        b = min(dist[i][labels == m].mean() for m in set(labels) if m != l)
        want.append(0.0 if own.sum() == 1 else (b - a) / max(a, b))
    assert cluster.silhouette_squared(df, COLS).first().silhouette == pytest.approx(np.mean(want))
    unusable = df.withColumn("cluster", F.lit(0))
    assert cluster.silhouette_squared(unusable, COLS).first().silhouette is None


def test_labels_do_not_depend_on_the_file_layout(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(1500)], "id int, x double, y double")
    labels = [
        {r.id: r.cluster for r in cluster.kmeans_entities(df.repartition(n), COLS, 4, restarts=2).collect()}
        for n in (1, 3, 8)
    ]
    assert labels[0] == labels[1] == labels[2] and len(labels[0]) == 1500


def test_silhouette_of_identical_points(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, i % 2) for i in range(6)], "id int, x double, y double, cluster int")
    assert cluster.silhouette(df, ["id"], COLS).first().silhouette == 0.0
    assert cluster.davies_bouldin(df, COLS).first().davies_bouldin == 0.0


@pytest.mark.parametrize("n,k", [(40, 3), (90, 5), (6, 2)])
def test_davies_bouldin_equals_formula(spark, n, k):
    df, data = points(spark, n, k)
    assert cluster.davies_bouldin(df, COLS).first().davies_bouldin == pytest.approx(davies_bouldin_by_hand(data))


def test_quality_is_missing_for_unusable_labels(spark):
    df, _ = points(spark, 5, 5)  # every entity its own cluster
    row = cluster.cluster_quality(df, ["id"], COLS).first()
    assert (row.silhouette, row.davies_bouldin, row.quality) == (None, None, "Needs Improvement")
    one, _ = points(spark, 5, 1)
    assert cluster.cluster_quality(one, ["id"], COLS).first().silhouette is None
    good, _ = points(spark, 60, 2)
    assert cluster.cluster_quality(good, ["id"], COLS).first().quality == "Good"


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    out = cluster.standardize(df, COLS).orderBy("x").collect()
    assert [(r.x_z, r.y_z) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def entities(n):
    demo = [(DAY0, "S", f"D{i}", i, 100 * (i % 3) + i, 10 + i) for i in range(n)]
    enrol = [(DAY0, "S", f"D{i}", i, i % 2, 2, 3) for i in range(n)]
    return demo, enrol


@pytest.mark.parametrize("n", [1, 2, 6, 7])
def test_cluster_report_sizes(spark, n):
    demo, enrol = entities(n)
    report = cluster.cluster_report(three(spark, demo, enrol=enrol))
    clusters = report["clusters"].orderBy("cluster").collect()
    if n < 2:
        assert clusters == []
        return
    assert len(clusters) == min(6, n) and sum(c["size"] for c in clusters) == n
    means = [c.avg_demographic + c.avg_enrollment for c in clusters]
    assert means == sorted(means, reverse=True)
    quality = report["quality"].first()
    assert (quality.silhouette is None) == (n <= 6)
    assert report["top"].count() == n


def test_cluster_report_of_one_district_uses_the_finest_level(spark):
    demo = [(DAY0, "S", "D", i, i * i, i) for i in range(12)]
    report = cluster.cluster_report(three(spark, demo), "S", "D")
    assert "pincode" in report["entities"].columns and report["entities"].count() == 12


def test_separated_groups_are_found(spark):
    demo = [(DAY0, "S", f"D{i}", i, 10 ** (1 + i % 3), 10 ** (1 + i % 3) + i) for i in range(30)]
    f = three(spark, demo)
    assigned = cluster.kmeans_pincodes(f.demographic, 3)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster, set()).add(r.pincode % 3)
    assert groups == {0: {2}, 1: {1}, 2: {0}}
    centers = cluster.cluster_centers(assigned, ["d1", "d2"]).orderBy("cluster").collect()
    assert [c["size"] for c in centers] == [10, 10, 10] and centers[0].center_d1 == 1000


def test_categories_of_both_variants(spark):
    data = [("a", 100, 10, 0, 0, 0, 1), ("b", 1, 10, 9, 9, 9, 2), ("c", 10, 2, 0, 1, 0, 3)]
    df = spark.createDataFrame(data, "id string, d1 int, d2 int, e1 int, e2 int, e3 int, cluster int")
    for variant in ("report", "export"):
        out = cluster.cluster_profile(df, ["d1", "d2"], ["e1", "e2", "e3"], variant).orderBy("cluster")
        assert [r.category for r in out.collect()] == ["High Activity", "Growing Region", "Stable Region"]
    bubbles = cluster.cluster_bubbles(cluster.cluster_profile(df, ["d1", "d2"], ["e1", "e2", "e3"]))
    assert {r.r for r in bubbles.collect()} == {2.0}


def test_export_has_a_category_per_district(spark):
    demo, enrol = entities(9)
    out = cluster.clusters_with_category(three(spark, demo, enrol=enrol))
    assert out.count() == 9 and out.filter(F.col("cluster_category").isNull()).count() == 0
