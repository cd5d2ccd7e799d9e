"""Sources, sinks, filters and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.checks.base import (
    REN_SUMS,
    SGN,
    SGN_SUMS,
    UPD,
    UPD_SUMS,
    big,
    query,
    rounded,
    through_csv,
)
from tallymap.functions import columns, names
from tallymap.operators import filters, joins
from tallymap.operators.rollup import daily_totals, rollup_by, rollup_named
from tallymap.plans import dashboard
from tallymap.sources import csv_parts, exports, fixtures
from tallymap.sources.csv_parts import DATE_FORMAT
from tallymap.sources.scratch import fresh_path
from tallymap.spec import Fact, FactSet

# Raw spellings and the names they must get, by position (customer key modulo their number).
RAW_NAMES = (
    (None, "Unknown"), ("", "Unknown"), ("100000", "Unknown"), ("560001", "Unknown"),
    ("Jaipur", "Unknown"), (" odisha ", "Odisha"), ("\tKerala", "Kerala"), ("ORISSA", "Odisha"),
    ("West Bangal", "West Bengal"), ("J&K", "Jammu & Kashmir"), ("new delhi", "Delhi"),
    ("Goalpara", "Goa"), ("Daman & Diu", "Dadra & Nagar Haveli and Daman & Diu"),
    ("Uttar", "Uttar Pradesh"), ("pradesh", "Andhra Pradesh"), ("   ", "Andhra Pradesh"),
    ("foo-bar", "Foo-Bar"), ("o'neil x", "O'Neil X"), ("zzz 9a", "Zzz 9A"),
    ("WEST  BENGAL", "West  Bengal"),
)
STRICT_NAMES = {"new delhi": "New Delhi", "Goalpara": "Goalpara", "Daman & Diu": "Daman & Diu",
                "Uttar": "Uttar", "pradesh": "Pradesh", "   ": "Unknown"}


def _values(pairs) -> str:
    rows = [f"({i}, '{name.replace(chr(39), chr(39) * 2)}')" for i, name in enumerate(pairs)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(i, name)"


NAMES_SQL = _values([name for _, name in RAW_NAMES])
STRICT_SQL = _values([STRICT_NAMES.get(raw, name) for raw, name in RAW_NAMES])


def _raw_state(key: str = "pincode"):
    raw = F.array(*[F.lit(r) for r, _ in RAW_NAMES])
    return F.get(raw, (F.col(key) % len(RAW_NAMES)).cast("int"))


def _write_raw(fact: Fact, part=None) -> str:
    """The fact as CSV files in the shape the sources deliver: dates as text."""
    path = fresh_path(fact.df.sparkSession, f"raw-{fact.spec.name}")
    out = fact.df.withColumn("date", F.date_format("date", DATE_FORMAT))
    if part is None:
        exports.write_csv(out, path)
    else:
        writer = out.withColumn("part", part).write.partitionBy("part").option("header", True)
        writer.csv(path)
    return path


@query(f"SELECT date, state, {SGN_SUMS}, CAST(COUNT(*) AS BIGINT) AS n FROM signups GROUP BY date, state")
def scan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.signups(spark, sf_dir)
    part = F.when(F.col("sgn_first") == 1, "first").when(F.col("sgn_act") == 1, "act").otherwise("look")
    path = _write_raw(fact, part)
    rows = csv_parts.scan_parts(spark, [f"{path}/part={p}" for p in ("first", "act", "look")], fact.spec)
    sums = [F.sum(m).alias(m) for m in fact.spec.measures]
    return csv_parts.parse_dates(rows).groupBy("date", "state").agg(*sums, F.count("pincode").alias("n"))


@query("SELECT CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n FROM orders GROUP BY 1")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fixtures.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", DATE_FORMAT).alias("date"))
    return csv_parts.parse_dates(text).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT CASE WHEN o_orderstatus = 'P' AND (day(o_orderdate) < 10 OR month(o_orderdate) < 10)
                THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, COUNT(*) AS n
    FROM orders GROUP BY 1""")
def parse_dates_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.date_format("o_orderdate", "d-M-yyyy")
    text = fixtures.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", short)
        .otherwise(F.date_format("o_orderdate", DATE_FORMAT)).alias("date")
    )
    return csv_parts.parse_dates(text, strict=False).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def _loaded(spark: SparkSession, sf_dir: str) -> FactSet:
    raw = fixtures.facts(spark, sf_dir).map(lambda f: f.on(f.df.withColumn("state", _raw_state())))
    return csv_parts.load_facts(spark, [f.spec for f in raw.all()], [[_write_raw(f)] for f in raw.all()])


@query(
    f"""
    SELECT 'updates' AS dataset, name AS state, COUNT(*) AS n, {big(UPD, 'total')}
    FROM updates JOIN names ON pincode % 20 = i GROUP BY name
    UNION ALL
    SELECT 'renewals', name, COUNT(*), CAST(SUM(ren_done + ren_open) AS BIGINT)
    FROM renewals JOIN names ON pincode % 20 = i GROUP BY name
    UNION ALL
    SELECT 'signups', name, COUNT(*), CAST(SUM({SGN}) AS BIGINT)
    FROM signups JOIN names ON pincode % 20 = i GROUP BY name""",
    names=NAMES_SQL,
)
def load_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for f in _loaded(spark, sf_dir).all():
        rows = columns.with_total(f.df, f.spec.measures).groupBy("state").agg(
            F.count("date").alias("n"), F.sum("total").alias("total")
        )
        parts.append(rows.select(F.lit(f.spec.name).alias("dataset"), "state", "n", "total"))
    return reduce(DataFrame.unionByName, parts)


# What is wrong with a row, by its place (customer key modulo 40), and the row's fields then.
FAULTS = {
    3: ("date", lambda f: {**f, "date": F.lit("31-02-2025")}),
    7: ("pincode", lambda f: {**f, "pincode": F.lit("x7")}),
    11: ("upd_new", lambda f: {**f, "upd_new": F.lit("1.5e")}),
    13: ("date, upd_old", lambda f: {**f, "date": F.lit("2025-01-31"), "upd_old": F.lit("--")}),
    17: ("field count", lambda f: {n: c for n, c in f.items() if n != "district"}),
    19: ("field count", lambda f: {**f, "more": F.lit("9")}),
}


def _write_faulty(fact: Fact) -> str:
    """The fact as CSV files in which some rows cannot be read."""
    fields = {
        "date": F.date_format("date", DATE_FORMAT), "state": F.coalesce("state", F.lit("")),
        **{c: F.col(c).cast("string") for c in ("district", "pincode", *fact.spec.measures)},
    }
    line = F.concat_ws(",", *fields.values())
    for place, (_, change) in FAULTS.items():
        line = F.when(F.col("pincode") % 40 == place, F.concat_ws(",", *change(fields).values())).otherwise(line)
    path = fresh_path(fact.df.sparkSession, "faulty")
    lines = fact.df.withColumn("state", F.when(_raw_state().rlike("^[^\t ].*[^ ]$"), _raw_state())).select(line.alias(",".join(fields)))
    lines.write.option("header", True).option("sep", "|").csv(path)
    return path


FAULT_SQL = " ".join(f"WHEN {place} THEN '{problem}'" for place, (problem, _) in FAULTS.items())


@query(
    f"""
    SELECT problem, CASE WHEN problem IS NULL THEN name END AS state, COUNT(*) AS n,
           CASE WHEN problem IS NULL THEN CAST(SUM({UPD}) AS BIGINT) END AS total
    FROM (SELECT CASE pincode % 40 {FAULT_SQL} END AS problem, upd_new, upd_old,
                 CASE WHEN pincode % 20 IN (5, 6, 15) THEN 'Unknown' ELSE name END AS name
          FROM updates JOIN names ON pincode % 20 = i)
    GROUP BY 1, 2""",
    names=NAMES_SQL,
)
def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    load = csv_parts.load_checked(spark, fact.spec, [_write_faulty(fact)])
    amount = F.coalesce("upd_new", F.lit(0)) + F.coalesce("upd_old", F.lit(0))
    good = load.fact.df.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    bad = load.rejects.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    return good.withColumn("problem", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query(
    "SELECT c_custkey AS pincode, name FROM customer JOIN names ON c_custkey % 20 = i",
    names=NAMES_SQL,
)
def normalize_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pincode"), _raw_state("c_custkey").alias("name")
    )
    return names.normalize_by_value(raw, "name")


@query(
    """
    SELECT dataset, COUNT(*) AS n_states, string_agg(name, '|' ORDER BY name) AS states FROM (
        SELECT DISTINCT 'updates' AS dataset, name FROM updates JOIN names ON pincode % 20 = i
        UNION ALL SELECT DISTINCT 'renewals', name FROM renewals JOIN names ON pincode % 20 = i
        UNION ALL SELECT DISTINCT 'signups', name FROM signups JOIN names ON pincode % 20 = i)
    GROUP BY dataset""",
    names=NAMES_SQL,
)
def load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = fixtures.facts(spark, sf_dir).map(
        lambda f: f.on(names.normalize_region_name(f.df.withColumn("state", _raw_state())))
    )
    return csv_parts.load_summary(cleaned).withColumn("states", F.array_join("states", "|"))


@query("""
    SELECT 'updates' AS dataset, COUNT(*) AS records, 'date,state,district,pincode,upd_new,upd_old' AS fields FROM updates
    UNION ALL SELECT 'renewals', COUNT(*), 'date,state,district,pincode,ren_done,ren_open' FROM renewals
    UNION ALL SELECT 'signups', COUNT(*), 'date,state,district,pincode,sgn_first,sgn_act,sgn_look' FROM signups""")
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_parts.dataset_catalog(fixtures.facts(spark, sf_dir)).withColumn("fields", F.array_join("fields", ","))


@query(
    "SELECT c_custkey AS pincode, name FROM customer JOIN names ON c_custkey % 20 = i",
    names=NAMES_SQL,
)
def normalize_region_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pincode"), _raw_state("c_custkey").alias("name")
    )
    return names.normalize_region_name(raw, "name")


@query(
    "SELECT c_custkey AS pincode, name FROM customer JOIN names ON c_custkey % 20 = i",
    names=STRICT_SQL,
)
def normalize_region_name_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pincode"), _raw_state("c_custkey").alias("name")
    )
    return names.normalize_region_name(raw, "name", strict=True)


@query(
    f"SELECT name AS state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates JOIN names ON pincode % 20 = i GROUP BY name",
    names=NAMES_SQL,
)
def normalized_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    return rollup_named(fact.on(fact.df.withColumn("state", _raw_state())), ["state"])


# --- sinks -------------------------------------------------------------------------------


@query(f"SELECT state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state")
def export_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_csv(exports.export_rollup(fixtures.updates(spark, sf_dir)), "rollup")


@query(f"SELECT district, {UPD_SUMS}, {big(UPD, 'total')} FROM updates WHERE state = 'ASIA' GROUP BY district")
def export_rollup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_csv(exports.export_rollup(fixtures.updates(spark, sf_dir), "ASIA"), "rollup")


@query(f"SELECT state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates WHERE district = 'NATION_7' GROUP BY state")
def export_rollup_district_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exports.export_rollup(fixtures.updates(spark, sf_dir), district="NATION_7")
    return through_csv(rows, "rollup")


SPIKE_CTES = {
    "daily": f"SELECT date, state, {big(UPD, 'total')} FROM updates GROUP BY date, state",
    "rolled": """
        SELECT *, AVG(total) OVER w AS rolling_avg, STDDEV_SAMP(total) OVER w AS rolling_std,
               COUNT(*) OVER (PARTITION BY state) AS days
        FROM daily WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
}


@query(
    """
    SELECT date, state, total AS value, ROUND(rolling_avg, 4) AS rolling_avg, ROUND(rolling_std, 4) AS rolling_std,
           ROUND((total - rolling_avg) / NULLIF(rolling_avg, 0) * 100, 4) AS deviation_percent,
           CASE WHEN total > rolling_avg + 3 * rolling_std THEN 'high' ELSE 'medium' END AS severity
    FROM rolled WHERE days >= 7 AND total > rolling_avg + 2 * rolling_std""",
    **SPIKE_CTES,
)
def export_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = through_csv(exports.export_spikes(fixtures.updates(spark, sf_dir)), "spikes")
    return rounded(rows, ["rolling_avg", "rolling_std", "deviation_percent"])


@query()
def export_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_csv(exports.export_clusters(fixtures.facts(spark, sf_dir)), "clusters")


@query(
    """
    SELECT 'high' AS priority, 'enrollment' AS category, 'enrolments_low' AS code, s.total AS value,
           u.total * 0.5 AS "limit", u.total * 0.5 - s.total AS gap, ROUND(s.total / u.total * 100, 1) AS percent
    FROM s, u WHERE s.total < u.total * 0.5""",
    u=f"SELECT CAST(SUM({UPD}) AS DOUBLE) AS total FROM updates",
    s=f"SELECT CAST(SUM({SGN}) AS DOUBLE) AS total FROM signups",
)
def export_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_csv(exports.export_recommendations(fixtures.facts(spark, sf_dir)), "recommendations")


def _region_sql() -> dict[str, str]:
    return {
        "select": """
        SELECT 'state' AS level, state AS name, COALESCE(total_enrollments, 0) AS total_enrollments,
               COALESCE(avg_daily, 0) AS avg_daily, COALESCE(peak, 0) AS peak,
               CASE WHEN COALESCE(avg_daily, 0) <> 0 AND COALESCE(peak, 0) <> 0
                    THEN ROUND(CAST(avg_daily AS DOUBLE) / peak * 100, 1) ELSE 0.0 END AS capacity_pct,
               upd_new, upd_old, ren_done, ren_open,
               CAST(ceil(COALESCE(avg_daily, 0) / 150.0) AS BIGINT) * 25000 + 88000 AS monthly_cost
        FROM u LEFT JOIN r USING (state) LEFT JOIN s USING (state)""",
        "u": f"SELECT state, {UPD_SUMS} FROM updates GROUP BY state",
        "r": f"SELECT state, {REN_SUMS} FROM renewals GROUP BY state",
        "d": f"SELECT state, date, {big(SGN, 'total')} FROM signups GROUP BY state, date",
        "s": """SELECT state, CAST(SUM(total) AS BIGINT) AS total_enrollments,
                       CAST(trunc(SUM(total) / COUNT(date)) AS BIGINT) AS avg_daily, MAX(total) AS peak
                FROM d GROUP BY state""",
    }


@query(**_region_sql())
def export_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_csv(exports.export_region_report(fixtures.facts(spark, sf_dir)), "regions")


@query(**_region_sql())
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.region_report(fixtures.facts(spark, sf_dir), "state")


@query(
    """
    SELECT 'country' AS level, 'all' AS name, total_enrollments, avg_daily, peak,
           ROUND(CAST(avg_daily AS DOUBLE) / peak * 100, 1) AS capacity_pct, upd_new, upd_old, ren_done, ren_open,
           CAST(ceil(avg_daily / 150.0) AS BIGINT) * 25000 + 88000 AS monthly_cost
    FROM u, r, s""",
    u=f"SELECT {UPD_SUMS} FROM updates",
    r=f"SELECT {REN_SUMS} FROM renewals",
    d=f"SELECT date, {big(SGN, 'total')} FROM signups GROUP BY date",
    s="""SELECT CAST(SUM(total) AS BIGINT) AS total_enrollments, MAX(total) AS peak,
                CAST(trunc(SUM(total) / COUNT(date)) AS BIGINT) AS avg_daily FROM d""",
)
def region_report_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.region_report(fixtures.facts(spark, sf_dir), None)


# --- filters and scalar functions ---------------------------------------------------------


@query("SELECT * FROM updates WHERE state = 'ASIA' AND district = 'NATION_7'")
def filter_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_region(fixtures.updates(spark, sf_dir), "ASIA", "NATION_7").df


@query("SELECT * FROM signups WHERE state = 'EUROPE'")
def filter_region_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_region(fixtures.signups(spark, sf_dir), "EUROPE").df


@query("SELECT * FROM signups WHERE pincode IN (3, 17, 5)")
def filter_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_entities(fixtures.signups(spark, sf_dir), "pincode", ["3", "17", "x", "5"]).df


@query("SELECT * FROM updates WHERE date >= (SELECT MAX(date) FROM updates) - 30")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.recent_activity(fixtures.updates(spark, sf_dir)).df


@query("SELECT date, COUNT(*) AS n FROM signups WHERE date >= (SELECT MAX(date) FROM updates) - 30 GROUP BY date")
def recent_activity_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = filters.recent_activity(fixtures.signups(spark, sf_dir), fixtures.updates(spark, sf_dir))
    return recent.df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT date, {REN_SUMS}, {big('ren_done + ren_open', 'total')} FROM renewals
           WHERE date >= (SELECT MAX(date) FROM renewals) - 90 GROUP BY date""")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_totals(filters.date_range(fixtures.renewals(spark, sf_dir), 90))


@query(f"SELECT *, {UPD} AS total FROM updates")
def with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.updates(spark, sf_dir)
    return columns.with_total(fact.df, fact.spec.measures)


@query("""SELECT DISTINCT date, CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(month(date) AS INTEGER) AS month,
                 CAST(isodow(date) - 1 AS INTEGER) AS day_of_week FROM updates""")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = fixtures.updates(spark, sf_dir).df.select("date").distinct()
    return dates.withColumns(columns.calendar_cols("date"))


@query(
    "SELECT state, total, ROUND(total / NULLIF((SELECT SUM(total) FROM s), 0) * 100, 2) AS percent FROM s",
    s=f"SELECT state, {big(UPD, 'total')} FROM updates GROUP BY state",
)
def share_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollup_by(fixtures.updates(spark, sf_dir), ["state"]).select("state", "total")
    whole = totals.agg(F.sum("total")).scalar()
    return totals.withColumn("percent", columns.share(F.col("total"), whole))


@query("SELECT DISTINCT date, strftime(date, '%Y-%m-%d') AS day FROM renewals")
def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.renewals(spark, sf_dir).df.select("date", columns.iso("date").alias("day")).distinct()


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def truncate_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.table(spark, sf_dir, "customer").select(
        "c_custkey", columns.trunc_long(F.col("c_acctbal")).alias("whole")
    )


@query(f"SELECT date, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY date")
def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = fixtures.signups(spark, sf_dir)
    first = F.col("sgn_first") == 1
    return daily_totals(joins.concat_parts([fact.on(fact.df.filter(first)), fact.on(fact.df.filter(~first))]))
