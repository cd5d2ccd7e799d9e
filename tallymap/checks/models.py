"""Clusters, forecasts, rules, capacity, cost and quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymap.checks.base import REN, REN_SUMS, SGN, SGN_SUMS, UPD, UPD_SUMS, big, query, rounded
from tallymap.checks.series import DAILY, _growth, _numbered
from tallymap.operators import capacity, cluster, forecast, joins, quality, rollup, rules, trends
from tallymap.sources import fixtures

FEATURES = ("upd_new", "upd_old", "sgn_first", "sgn_act", "sgn_look")
FIRST, SECOND = FEATURES[:2], FEATURES[2:]
KEYS = ("state", "district")

FEATURE_SQL = {
    "u": f"SELECT state, district, {UPD_SUMS} FROM updates GROUP BY state, district",
    "s": f"SELECT state, district, {SGN_SUMS} FROM signups GROUP BY state, district",
    "feat": """SELECT u.*, COALESCE(sgn_first, 0) AS sgn_first, COALESCE(sgn_act, 0) AS sgn_act,
                      COALESCE(sgn_look, 0) AS sgn_look FROM u LEFT JOIN s USING (state, district)""",
}
Z = ", ".join(
    f"({c} - AVG({c}) OVER ()) / (CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 1 ELSE STDDEV_POP({c}) OVER () END) AS {c}_z"
    for c in FEATURES
)
ASSIGNED_SQL = {
    **FEATURE_SQL,
    "assigned": """SELECT *, CAST(ntile(4) OVER (PARTITION BY state ORDER BY upd_new + upd_old DESC, district) AS INTEGER)
                          AS cluster FROM feat""",
    "scaled": f"SELECT *, {Z} FROM assigned",
}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return joins.entity_features(facts.demographic, facts.enrolment).drop("n_pincodes")


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts with a cluster that does not depend on a fit: quartile within the state."""
    order = W.partitionBy("state").orderBy(F.desc(F.col("upd_new") + F.col("upd_old")), "district")
    return _features(spark, sf_dir).withColumn("cluster", F.ntile(4).over(order))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.standardize(_assigned(spark, sf_dir), FEATURES)


SCALED_COLS = [f"{c}_z" for c in FEATURES]


@query(
    f"SELECT state, district, {', '.join(FEATURES)}, {', '.join(f'ROUND({c}_z, 6) AS {c}_z' for c in FEATURES)} FROM z",
    **FEATURE_SQL,
    z=f"SELECT *, {Z} FROM feat",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = cluster.standardize(_features(spark, sf_dir), FEATURES)
    return rounded(scaled, SCALED_COLS, 6)


@query(
    """SELECT pincode, ROUND((upd_new - AVG(upd_new) OVER ()) / STDDEV_POP(upd_new) OVER (), 6) AS upd_new_z,
              ROUND((upd_old - AVG(upd_old) OVER ()) / STDDEV_POP(upd_old) OVER (), 6) AS upd_old_z FROM p""",
    p=f"SELECT pincode, {UPD_SUMS} FROM updates GROUP BY pincode",
)
def standardize_pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    scaled = cluster.standardize(rollup.pincode_features(fact), fact.spec.measures)
    return rounded(scaled, ["upd_new_z", "upd_old_z"], 6).select("pincode", "upd_new_z", "upd_old_z")


def _means(cols) -> str:
    return " + ".join(f"AVG({c})" for c in cols)


def _profile_sql(factor: str, growth) -> str:
    return f"""
        SELECT cluster, size, ROUND(d, 4) AS avg_demographic, ROUND(e, 4) AS avg_enrollment,
               CASE WHEN d > gd * {factor} THEN 'High Activity' WHEN g > gg * {factor} THEN 'Growing Region'
                    ELSE 'Stable Region' END AS category
        FROM (SELECT cluster, COUNT(*) AS size, {_means(FIRST)} AS d, {_means(SECOND)} AS e, {_means(growth)} AS g
              FROM assigned GROUP BY cluster),
             (SELECT {_means(FIRST)} AS gd, {_means(growth)} AS gg FROM assigned)"""


@query(_profile_sql("1.2", SECOND), **ASSIGNED_SQL)
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = cluster.cluster_profile(_assigned(spark, sf_dir), FIRST, SECOND)
    return rounded(profile, ["avg_demographic", "avg_enrollment"])


@query(_profile_sql("1.0", SECOND[:1]), **ASSIGNED_SQL)
def cluster_profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = cluster.cluster_profile(_assigned(spark, sf_dir), FIRST, SECOND, "export")
    return rounded(profile, ["avg_demographic", "avg_enrollment"])


@query(
    f"""SELECT cluster, ROUND({_means(FIRST)}, 4) AS x, ROUND({_means(SECOND)}, 4) AS y,
               ROUND(sqrt(COUNT(*)) * 2, 4) AS r FROM assigned GROUP BY cluster""",
    **ASSIGNED_SQL,
)
def cluster_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = cluster.cluster_profile(_assigned(spark, sf_dir), FIRST, SECOND)
    return rounded(cluster.cluster_bubbles(profile), ["x", "y", "r"])


@query(
    f"""SELECT cluster, COUNT(*) AS size, {', '.join(f'ROUND(AVG({c}), 4) AS center_{c}' for c in FIRST)}
        FROM assigned GROUP BY cluster""",
    **ASSIGNED_SQL,
)
def cluster_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = cluster.cluster_centers(_assigned(spark, sf_dir), FIRST)
    return rounded(centers, [f"center_{c}" for c in FIRST])


@query(
    f"""SELECT * FROM (SELECT state, district, {', '.join(FEATURES)}, cluster,
                CAST(row_number() OVER (PARTITION BY cluster ORDER BY upd_new DESC, state, district) AS INTEGER) AS rank
              FROM assigned) WHERE rank <= 5""",
    **ASSIGNED_SQL,
)
def top_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_top(_assigned(spark, sf_dir), "upd_new", KEYS)


DIST = "sqrt(" + " + ".join(f"power(x.{c}_z - y.{c}_z, 2)" for c in FEATURES) + ")"
SILHOUETTE_SQL = {
    **ASSIGNED_SQL,
    "means": f"""
        SELECT x.state, x.district, x.cluster, y.cluster AS other, SUM({DIST}) AS dist, COUNT(*) AS n
        FROM scaled x, scaled y GROUP BY ALL""",
    "ab": """
        SELECT state, district, cluster, MAX(CASE WHEN other = cluster THEN n END) AS size,
               MAX(CASE WHEN other = cluster THEN dist / NULLIF(n - 1, 0) END) AS a,
               MIN(CASE WHEN other <> cluster THEN dist / n END) AS b FROM means GROUP BY ALL""",
    "samples": """SELECT *, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS value FROM ab""",
}
CENTER_DIST = "sqrt(" + " + ".join(f"power(x.c_{c} - y.c_{c}, 2)" for c in FEATURES) + ")"
OWN_DIST = "sqrt(" + " + ".join(f"power({c}_z - c_{c}, 2)" for c in FEATURES) + ")"
DB_SQL = {
    "cent": f"SELECT cluster, {', '.join(f'AVG({c}_z) AS c_{c}' for c in FEATURES)} FROM scaled GROUP BY cluster",
    "spread": f"SELECT cluster, AVG({OWN_DIST}) AS sp FROM scaled JOIN cent USING (cluster) GROUP BY cluster",
    "cs": "SELECT * FROM cent JOIN spread USING (cluster)",
    "worst": f"""SELECT x.cluster, MAX((x.sp + y.sp) / {CENTER_DIST}) AS r
                 FROM cs x JOIN cs y ON x.cluster <> y.cluster GROUP BY x.cluster""",
}


@query("SELECT state, district, cluster, ROUND(value, 6) AS silhouette FROM samples", **SILHOUETTE_SQL)
def silhouette_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Small blocks, so several tasks compare blocks even on the 25 districts.
    samples = cluster.silhouette_samples(_scaled(spark, sf_dir), KEYS, SCALED_COLS, block_rows=10)
    return rounded(samples, ["silhouette"], 6)


@query("SELECT ROUND(AVG(value), 6) AS silhouette FROM samples", **SILHOUETTE_SQL)
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.silhouette(_scaled(spark, sf_dir), KEYS, SCALED_COLS), ["silhouette"], 6)


@query(
    "SELECT ROUND(AVG(value), 6) AS silhouette FROM samples",
    **{**SILHOUETTE_SQL, "means": SILHOUETTE_SQL["means"].replace(DIST, f"power({DIST}, 2)")},
)
def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.silhouette_squared(_scaled(spark, sf_dir), SCALED_COLS), ["silhouette"], 6)


@query("SELECT ROUND(AVG(r), 6) AS davies_bouldin FROM worst", **ASSIGNED_SQL, **DB_SQL)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.davies_bouldin(_scaled(spark, sf_dir), SCALED_COLS), ["davies_bouldin"], 6)


@query(
    """SELECT ROUND(s, 6) AS silhouette, ROUND(d, 6) AS davies_bouldin,
              CASE WHEN s > 0.5 THEN 'Good' WHEN s > 0.25 THEN 'Fair' ELSE 'Needs Improvement' END AS quality
       FROM (SELECT AVG(value) AS s FROM samples), (SELECT AVG(r) AS d FROM worst)""",
    **SILHOUETTE_SQL,
    **DB_SQL,
)
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = cluster.cluster_quality(_scaled(spark, sf_dir), KEYS, SCALED_COLS)
    return rounded(scores, ["silhouette", "davies_bouldin"], 6)


PIN_Z = ", ".join(f"({c} - AVG({c}) OVER ()) / STDDEV_POP({c}) OVER () AS {c}_z" for c in FIRST)
PIN_GAP = " + ".join(f"power(x.{c}_z - y.{c}_z, 2)" for c in FIRST)
PIN_OWN = "sqrt(" + " + ".join(f"power({c}_z - c_{c}, 2)" for c in FIRST) + ")"
PIN_CENTER = "sqrt(" + " + ".join(f"power(x.c_{c} - y.c_{c}, 2)" for c in FIRST) + ")"


@query(
    """SELECT ROUND(s, 6) AS silhouette, ROUND(d, 6) AS davies_bouldin,
              CASE WHEN s > 0.5 THEN 'Good' WHEN s > 0.25 THEN 'Fair' ELSE 'Needs Improvement' END AS quality
       FROM (SELECT AVG(value) AS s FROM samples), (SELECT AVG(r) AS d FROM worst)""",
    p=f"SELECT pincode, {UPD_SUMS} FROM updates GROUP BY pincode",
    scaled=f"""SELECT pincode, {PIN_Z}, CAST(least(floor(({UPD}) / AVG({UPD}) OVER () * 2), 3) AS INTEGER) AS cluster
               FROM p""",
    means=f"""SELECT x.pincode, x.cluster, y.cluster AS other, SUM({PIN_GAP}) AS dist, COUNT(*) AS n
              FROM scaled x, scaled y GROUP BY ALL""",
    ab="""SELECT pincode, MAX(CASE WHEN other = cluster THEN n END) AS size,
                 MAX(CASE WHEN other = cluster THEN dist / NULLIF(n - 1, 0) END) AS a,
                 MIN(CASE WHEN other <> cluster THEN dist / n END) AS b FROM means GROUP BY ALL""",
    samples="SELECT *, CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS value FROM ab",
    cent=f"SELECT cluster, {', '.join(f'AVG({c}_z) AS c_{c}' for c in FIRST)} FROM scaled GROUP BY cluster",
    spread=f"SELECT cluster, AVG({PIN_OWN}) AS sp FROM scaled JOIN cent USING (cluster) GROUP BY cluster",
    cs="SELECT * FROM cent JOIN spread USING (cluster)",
    worst=f"""SELECT x.cluster, MAX((x.sp + y.sp) / {PIN_CENTER}) AS r
              FROM cs x JOIN cs y ON x.cluster <> y.cluster GROUP BY x.cluster""",
)
def cluster_quality_pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finest regions in four bands of activity relative to the mean."""
    fact = fixtures.updates(spark, sf_dir)
    places = rollup.pincode_features(fact).select("pincode", *FIRST)
    amount = F.col("upd_new") + F.col("upd_old")
    mean = places.select(F.avg(amount)).scalar()
    banded = places.withColumn("cluster", F.least(F.floor(amount / mean * 2), F.lit(3)).cast("int"))
    scaled = cluster.standardize(banded, FIRST)
    scores = cluster.cluster_quality(scaled, ["pincode"], [f"{c}_z" for c in FIRST], squared=True)
    return rounded(scores, ["silhouette", "davies_bouldin"], 6)


@query()
def kmeans_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.kmeans_entities(_features(spark, sf_dir), FEATURES)


@query()
def kmeans_pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    return cluster.cluster_centers(cluster.kmeans_pincodes(fact), fact.spec.measures)


@query()
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_report(fixtures.facts(spark, sf_dir))["clusters"]


@query()
def cluster_report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_report(fixtures.facts(spark, sf_dir), "ASIA", "NATION_7")["quality"]


# --- forecasts -----------------------------------------------------------------------------


@query()
def forecast_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast_daily(rollup.daily_totals(fixtures.updates(spark, sf_dir)))


@query()
def calendar_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.calendar_model(fixtures.updates(spark, sf_dir)).predict()


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.calendar_model(fixtures.renewals(spark, sf_dir), "ASIA").importance()


def _inside(predicted: DataFrame, totals: DataFrame) -> DataFrame:
    """Predicted dates, and whether the prediction stays within the totals it was learnt from."""
    seen = totals.select(F.struct(F.min("total").alias("low"), F.max("total").alias("high"))).scalar()
    return predicted.select("date", F.col("predicted_total").between(seen["low"], seen["high"]).alias("inside"))


@query(
    """SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date, TRUE AS inside, CAST(1 AS BIGINT) AS levels
       FROM (SELECT MAX(date) AS last FROM updates), generate_series(1, 30) AS g(i)"""
)
def forecast_daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any fit: the dates, one level for all of them, within the series."""
    daily = rollup.daily_totals(fixtures.updates(spark, sf_dir))
    ahead = forecast.forecast_daily(daily)
    levels = ahead.select(F.count_distinct("predicted_total")).scalar()
    return _inside(ahead, daily).withColumn("levels", levels)


@query(
    """SELECT CAST(last + CAST(i AS INTEGER) AS DATE) AS date, TRUE AS inside
       FROM (SELECT MAX(date) AS last FROM updates), generate_series(1, 7) AS g(i)"""
)
def calendar_model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    return _inside(forecast.calendar_model(fact).predict(), rollup.calendar_totals(fact))


@query("SELECT CAST(3 AS BIGINT) AS features, 1.0::DOUBLE AS weight")
def feature_importance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = forecast.calendar_model(fixtures.renewals(spark, sf_dir), "ASIA").importance()
    return weights.agg(
        F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("weight")
    )


@query(
    "SELECT COUNT(*) AS entities, least(6, COUNT(*)) AS clusters, CAST(0 AS BIGINT) AS out_of_order FROM feat",
    **FEATURE_SQL,
)
def kmeans_entities_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any fit: all entities, as many clusters as asked for, numbered by mean total."""
    assigned = cluster.kmeans_entities(_features(spark, sf_dir), FEATURES)
    amount = sum((F.col(c) for c in FEATURES[1:]), start=F.col(FEATURES[0]))
    means = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(amount).alias("mean"))
    before = F.lag("mean").over(W.orderBy("cluster"))  # one row per cluster
    return means.withColumn("before", before).agg(
        F.sum("n").alias("entities"),
        F.count("*").alias("clusters"),
        F.count_if(F.col("mean") > F.col("before")).alias("out_of_order"),
    )


@query(
    """SELECT ROUND(1 - SUM((total - y_hat) * (total - y_hat)) / (VAR_POP(total) * COUNT(*)), 6) AS r2
       FROM (SELECT total, AVG(total) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS y_hat FROM daily)""",
    daily=DAILY,
)
def model_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = trends.moving_averages(rollup.daily_totals(fixtures.updates(spark, sf_dir)))
    return rounded(forecast.model_score(smooth, "total", "avg_7"), ["r2"], 6)


@query(
    """SELECT state, CAST(last + to_months(CAST(i AS INTEGER)) AS DATE) AS month,
              ROUND(greatest(0.0, avg_daily * 30 * (1 + growth / 100)), 4) AS predicted,
              CAST(greatest(50, 95 - 7 * i) AS INTEGER) AS confidence
       FROM p, generate_series(1, 6) AS g(i)""",
    daily=f"SELECT date, state, {big(UPD, 'total')} FROM updates GROUP BY date, state",
    numbered=_numbered("daily", "state"),
    p=f"""SELECT state, MAX(date) AS last, trunc(SUM(total) / COUNT(*)) AS avg_daily, {_growth('1', 7, 2)} AS growth
          FROM numbered GROUP BY state""",
)
def flat_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    projected = forecast.monthly_projection(fixtures.updates(spark, sf_dir), ["state"])
    return rounded(projected, ["predicted"])


# --- rules and capacity --------------------------------------------------------------------


def _rules_sql(by: str = "") -> dict[str, str]:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON TRUE"

    def rule(category: str, priority: str, code: str, value: str, base: str, factor: str) -> str:
        return f"""SELECT {key}'{priority}' AS priority, '{category}' AS category, '{code}' AS code,
                          CAST({value} AS DOUBLE) AS value, ROUND(CAST({base} * {factor} AS DOUBLE), 4) AS "limit",
                          ROUND(CAST({base} * {factor} - {value} AS DOUBLE), 4) AS gap,
                          COALESCE(ROUND(CAST({value} AS DOUBLE) / NULLIF({base}, 0) * 100, 1), 0.0) AS percent
                   FROM b WHERE {value} < {base} * {factor}"""

    return {
        "select": " UNION ALL ".join(
            [
                rule("enrollment", "high", "enrolments_low", "enrol", "demo", "0.5"),
                rule("coverage", "medium", "postcodes_sparse", "pincodes", "districts", "10"),
                rule("demographics", "high", "children_few", "child", "adult", "0.3"),
                rule("biometric", "medium", "biometrics_behind", "bio", "demo", "0.7"),
            ]
        ),
        "du": f"""SELECT {key}SUM({UPD}) AS demo, SUM(upd_new) AS child, SUM(upd_old) AS adult,
                         COUNT(DISTINCT district) AS districts, COUNT(DISTINCT pincode) AS pincodes FROM updates {group}""",
        "dr": f"SELECT {key}SUM({REN}) AS bio_sum FROM renewals {group}",
        "ds": f"SELECT {key}SUM({SGN}) AS enrol_sum FROM signups {group}",
        "b": f"""SELECT *, COALESCE(bio_sum, 0) AS bio, COALESCE(enrol_sum, 0) AS enrol
                 FROM du LEFT JOIN dr {join} LEFT JOIN ds {join}""",
    }


@query(**_rules_sql())
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.recommendations(fixtures.facts(spark, sf_dir)), ["limit", "gap"])


@query(**_rules_sql("pincode"))
def recommendations_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rules.recommendations(fixtures.facts(spark, sf_dir), ["pincode"]), ["limit", "gap"])


def _capacity_sql(fact: str, expr: str, by: str) -> dict[str, str]:
    return {
        "daily": f"SELECT date, {by}, {big(expr, 'total')} FROM {fact} GROUP BY date, {by}",
        "load": f"""SELECT {by}, CAST(trunc(SUM(total) / COUNT(*)) AS BIGINT) AS avg_daily, MAX(total) AS peak
                    FROM daily GROUP BY {by}""",
        "cap": """SELECT *, CASE WHEN avg_daily <> 0 AND peak <> 0
                         THEN ROUND(CAST(avg_daily AS DOUBLE) / peak * 100, 1) ELSE 0.0 END AS capacity FROM load""",
    }


@query(
    "SELECT pincode, avg_daily, peak, capacity, capacity > 70 AS efficient FROM cap",
    **_capacity_sql("signups", SGN, "pincode"),
)
def capacity_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.capacity_utilization(fixtures.signups(spark, sf_dir), ["pincode"])


COST_SQL = {
    "staffing": """SELECT *, capacity > 70 AS efficient, CAST(ceil(avg_daily / 150.0) AS BIGINT) AS staff,
                          CAST(ceil(peak / 150.0) AS BIGINT) AS peak_staff FROM cap""",
    "cost": """SELECT *, staff * 25000 AS staff_cost, staff * 25000 + 88000 AS monthly,
                      (staff * 25000 + 88000) * 12 AS annual,
                      CASE WHEN avg_daily > 0 THEN ROUND(CAST(staff * 25000 + 88000 AS DOUBLE) / (avg_daily * 30), 2)
                           ELSE 0.0 END AS cost_per_enrollment,
                      CASE WHEN avg_daily > 0 THEN ROUND(CAST(avg_daily AS DOUBLE) / staff, 0) ELSE 0.0 END AS productivity,
                      avg_daily * 30 * 100 AS revenue FROM staffing""",
}


@query("SELECT * FROM cost", **_capacity_sql("updates", UPD, "district"), **COST_SQL)
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = capacity.capacity_utilization(fixtures.updates(spark, sf_dir), ["district"])
    return capacity.cost_model(load)


@query(
    """SELECT pincode, flag FROM (
         SELECT pincode, unnest([
           CASE WHEN cost_per_enrollment > 200 THEN 'cost_high' END,
           CASE WHEN CAST(staff_cost AS DOUBLE) / monthly > 0.6 THEN 'staff_share_high' END,
           CASE WHEN peak_staff > staff * 1.5 THEN 'peak_demand' ELSE 'staff_balanced' END,
           CASE WHEN cost_per_enrollment < 150 THEN 'cost_optimal' END,
           CASE WHEN avg_daily < 1000 THEN 'volume_low' END,
           CASE WHEN avg_daily > 10000 THEN 'volume_high' END]) AS flag FROM cost)
       WHERE flag IS NOT NULL""",
    **_capacity_sql("updates", UPD, "pincode"),
    **COST_SQL,
)
def cost_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = capacity.capacity_utilization(fixtures.updates(spark, sf_dir), ["pincode"])
    return capacity.cost_advice(capacity.cost_model(load), ["pincode"])


@query(
    """SELECT state, 'Medium' AS priority, 'underused' AS code FROM load_growth WHERE used < 60
       UNION ALL SELECT state, 'High', 'strained' FROM load_growth WHERE used > 85
       UNION ALL SELECT state, 'Medium', 'trend_change' FROM load_growth WHERE abs(growth) > 10""",
    **_capacity_sql("signups", SGN, "state"),
    du=f"SELECT date, state, {big(UPD, 'total')} FROM updates GROUP BY date, state",
    numbered=_numbered("du", "state"),
    growth=f"SELECT state, {_growth('1', 7, 2)} AS growth FROM numbered GROUP BY state",
    load_growth="""SELECT state, CAST(avg_daily AS DOUBLE) / COALESCE(NULLIF(peak, 0), 1) * 100 AS used, growth
            FROM load LEFT JOIN growth USING (state)""",
)
def capacity_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.capacity_advice(fixtures.signups(spark, sf_dir), fixtures.updates(spark, sf_dir))


@query(
    """SELECT district, CAST(ceil(avg_daily / 200.0) AS BIGINT) AS centers, CAST(ceil(peak / 200.0) AS BIGINT) AS peak_centers,
              ROUND(peak * CAST(0.02 AS DOUBLE), 1) AS savings FROM load""",
    **_capacity_sql("updates", UPD, "district"),
)
def resource_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = capacity.capacity_utilization(fixtures.updates(spark, sf_dir), ["district"])
    return capacity.resource_plan(load, ["district"])


@query(
    """SELECT pincode, ROUND(CAST(demo AS DOUBLE) / NULLIF(COALESCE(enrol, 0), 0) * 100, 1) AS demo_vs_enrol_pct,
              ROUND(CAST(COALESCE(bio, 0) AS DOUBLE) / NULLIF(demo, 0) * 100, 1) AS bio_vs_demo_pct
       FROM du LEFT JOIN dr USING (pincode) LEFT JOIN ds USING (pincode)""",
    du=f"SELECT pincode, {big(UPD, 'demo')} FROM updates GROUP BY pincode",
    dr=f"SELECT pincode, {big(REN, 'bio')} FROM renewals GROUP BY pincode",
    ds=f"SELECT pincode, {big(SGN, 'enrol')} FROM signups GROUP BY pincode",
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.coverage_summary(fixtures.facts(spark, sf_dir), ["pincode"])


# --- quality -------------------------------------------------------------------------------

FROM, TO = date(1995, 3, 1), date(2001, 3, 31)
_COLUMNS = ("date", "state", "district", "pincode", "ren_done", "ren_open")
QUALITY_SQL = {
    "daily": f"SELECT date, {REN_SUMS}, {big(REN, 'total')} FROM renewals GROUP BY date",
    "z": "SELECT abs((total - AVG(total) OVER ()) / STDDEV_SAMP(total) OVER ()) AS z FROM daily",
    "checks": " UNION ALL ".join(
        [
            f"""SELECT 'missing' AS "check", '{c}' AS "column", COUNT(*) FILTER ({c} IS NULL) AS failed, COUNT(*) AS total
                FROM renewals"""
            for c in _COLUMNS
        ]
        + [f"SELECT 'date_range', 'date', COUNT(*) FILTER (date < '{FROM}' OR date > '{TO}'), COUNT(*) FROM renewals"]
        + [f"SELECT 'negative', '{c}', COUNT(*) FILTER ({c} < 0), COUNT(*) FROM renewals" for c in _COLUMNS[4:]]
        + [f"SELECT 'outlier_{k}sd', 'total', COUNT(*) FILTER (z > {k}), COUNT(*) FROM z" for k in (2, 3)]
        + [
            f"""SELECT 'absent_in_{other}', 'state', COUNT(*) FILTER (state NOT IN (SELECT state FROM {other})), COUNT(*)
                FROM (SELECT DISTINCT state FROM renewals)"""
            for other in ("updates", "signups")
        ]
    ),
}


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return quality.quality_report(facts.biometric, FROM, TO, [facts.demographic, facts.enrolment])


@query("SELECT *, ROUND(1 - CAST(failed AS DOUBLE) / NULLIF(total, 0), 4) AS pass_rate FROM checks", **QUALITY_SQL)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality(spark, sf_dir)


@query("SELECT ROUND(1 - CAST(SUM(failed) AS DOUBLE) / SUM(total), 6) AS score FROM checks", **QUALITY_SQL)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_score(_quality(spark, sf_dir))
