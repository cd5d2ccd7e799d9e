"""Group-bys, top-k reports, combinations of the tables, profiles and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymap.checks.base import (
    REN,
    REN_SUMS,
    SGN,
    SGN_SUMS,
    UPD,
    UPD_SUMS,
    big,
    query,
    rounded,
)
from tallymap.operators import anomaly, joins, rollup, topk
from tallymap.plans import dashboard
from tallymap.plans import profile as profiles
from tallymap.sources import fixtures
from tallymap.sources.cube import open_cube, save_cube
from tallymap.sources.scratch import fresh_path
from tallymap.spec import Fact


@query(
    "SELECT u.*, r.*, s.*, p.* FROM u, r, s, p",
    u=f"SELECT COUNT(*) AS updates_records, {UPD_SUMS}, MIN(date) AS start_date, MAX(date) AS end_date FROM updates",
    r=f"SELECT COUNT(*) AS renewals_records, {REN_SUMS} FROM renewals",
    s=f"SELECT COUNT(*) AS signups_records, {SGN_SUMS} FROM signups",
    p="""SELECT COUNT(DISTINCT state) AS states, COUNT(DISTINCT district) AS districts,
                COUNT(DISTINCT pincode) AS pincodes FROM updates""",
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.overview(fixtures.facts(spark, sf_dir))


@query(
    "SELECT u.*, r.*, s.*, p.* FROM u, r, s, p",
    u=f"SELECT COUNT(*) AS updates_records, {UPD_SUMS}, MIN(date) AS start_date, MAX(date) AS end_date FROM updates",
    r=f"SELECT COUNT(*) AS renewals_records, {REN_SUMS} FROM renewals",
    s=f"SELECT COUNT(*) AS signups_records, {SGN_SUMS} FROM signups",
    p="""SELECT COUNT(DISTINCT state) AS states, COUNT(DISTINCT district) AS districts,
                COUNT(DISTINCT pincode) AS pincodes FROM updates""",
)
def overview_of_saved_cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def saved(fact: Fact) -> Fact:
        path = fresh_path(spark, f"cube-{fact.spec.name}")
        save_cube(fact, path)
        return open_cube(spark, fact.spec, path)

    return rollup.overview(fixtures.facts(spark, sf_dir).map(saved))


@query(f"SELECT state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state")
def rollup_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_by(fixtures.updates(spark, sf_dir), ["state"])


@query(f"SELECT state, district, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY state, district")
def rollup_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_by(fixtures.signups(spark, sf_dir), ["state", "district"])


@query(f"SELECT pincode, {REN_SUMS}, {big(REN, 'total')} FROM renewals GROUP BY pincode")
def rollup_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_by(fixtures.renewals(spark, sf_dir), ["pincode"])


@query(f"""SELECT date, state, district, pincode, {UPD_SUMS}, COUNT(*) AS records
           FROM updates GROUP BY date, state, district, pincode""")
def daily_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_cube(fixtures.updates(spark, sf_dir)).df


@query(f"SELECT 'state' AS level, state AS key, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state")
def drill_down_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.drill_down(fixtures.updates(spark, sf_dir), district="NATION_7")


@query(f"""SELECT 'district' AS level, district AS key, {UPD_SUMS}, {big(UPD, 'total')}
           FROM updates WHERE state = 'ASIA' GROUP BY district""")
def drill_down_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.drill_down(fixtures.updates(spark, sf_dir), "ASIA")


@query(f"""SELECT 'pincode' AS level, CAST(pincode AS VARCHAR) AS key, {UPD_SUMS}, {big(UPD, 'total')}
           FROM updates WHERE state = 'ASIA' AND district = 'NATION_7' GROUP BY pincode""")
def drill_down_pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.drill_down(fixtures.updates(spark, sf_dir), "ASIA", "NATION_7")


@query(f"""
    SELECT 'state' AS level, state, NULL AS district, CAST(NULL AS BIGINT) AS pincode, {UPD_SUMS}, {big(UPD, 'total')}
    FROM updates GROUP BY state
    UNION ALL SELECT 'district', state, district, NULL, {UPD_SUMS}, {big(UPD, 'total')}
    FROM updates GROUP BY state, district
    UNION ALL SELECT 'pincode', state, district, pincode, {UPD_SUMS}, {big(UPD, 'total')}
    FROM updates GROUP BY state, district, pincode""")
def drill_down_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.drill_down_all(fixtures.updates(spark, sf_dir))


@query(f"""SELECT state, district, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state, district
           ORDER BY total DESC, state, district LIMIT 50""")
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.heatmap(fixtures.updates(spark, sf_dir))


@query(f"SELECT date, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY date")
def daily_totals_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_totals(fixtures.updates(spark, sf_dir))


@query(f"SELECT date, {REN_SUMS}, {big(REN, 'total')} FROM renewals GROUP BY date")
def daily_totals_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_totals(fixtures.renewals(spark, sf_dir))


@query(f"SELECT date, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY date")
def daily_totals_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_totals(fixtures.signups(spark, sf_dir))


@query(f"SELECT date, state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY date, state")
def daily_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_by_region(fixtures.updates(spark, sf_dir))


PLACES = """COUNT(DISTINCT state) AS states, COUNT(DISTINCT district) AS districts,
            COUNT(DISTINCT pincode) AS pincodes"""


@query(f"SELECT {PLACES} FROM signups")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.coverage(fixtures.signups(spark, sf_dir))


@query(f"SELECT state, {PLACES} FROM updates GROUP BY state")
def coverage_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The grouping level itself is always one.
    return rollup.coverage(fixtures.updates(spark, sf_dir), ["state"])


UPD_SHARES = f"""{UPD_SUMS},
    ROUND(SUM(upd_new) / NULLIF(SUM({UPD}), 0) * 100, 2) AS upd_new_percent,
    ROUND(SUM(upd_old) / NULLIF(SUM({UPD}), 0) * 100, 2) AS upd_old_percent"""


@query(f"SELECT {UPD_SHARES} FROM updates")
def age_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.age_distribution(fixtures.updates(spark, sf_dir))


@query(f"SELECT district, {UPD_SHARES} FROM updates GROUP BY district")
def age_distribution_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.age_distribution(fixtures.updates(spark, sf_dir), ["district"])


@query(f"""SELECT pincode, {UPD_SUMS}, MIN(state) AS state, MIN(district) AS district
           FROM updates GROUP BY pincode""")
def pincode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.pincode_features(fixtures.updates(spark, sf_dir))


@query("SELECT date, COUNT(*) AS n FROM updates GROUP BY date")
def daily_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.daily_record_counts(fixtures.updates(spark, sf_dir))


@query("SELECT district, COUNT(*) AS n FROM updates GROUP BY district ORDER BY n DESC, district LIMIT 10")
def region_record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.region_record_counts(fixtures.updates(spark, sf_dir), "district")


@query("SELECT state, COUNT(*) AS n FROM updates GROUP BY state ORDER BY n DESC, state LIMIT 10")
def top_by_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.region_record_counts(fixtures.updates(spark, sf_dir))


@query(f"""SELECT CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(month(date) AS INTEGER) AS month,
                  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, {big(UPD, 'total')}
           FROM updates GROUP BY 1, 2, 3""")
def calendar_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.calendar_totals(fixtures.updates(spark, sf_dir))


@query(f"""SELECT CAST(date_trunc('week', date) AS DATE) AS period, {UPD_SUMS}, {big(UPD, 'total')}
           FROM updates GROUP BY 1""")
def time_rollup_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.time_rollup(fixtures.updates(spark, sf_dir), "week")


@query(f"""SELECT CAST(date_trunc('month', date) AS DATE) AS period, {REN_SUMS}, {big(REN, 'total')}
           FROM renewals GROUP BY 1""")
def time_rollup_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.time_rollup(fixtures.renewals(spark, sf_dir), "month")


# --- top-k -------------------------------------------------------------------------------


@query(f"""SELECT state, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state
           ORDER BY total DESC, state LIMIT 15""")
def top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.updates(spark, sf_dir), ["state"], 15)


@query(f"""SELECT state, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY state
           ORDER BY total DESC, state LIMIT 15""")
def top_states_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.signups(spark, sf_dir), ["state"], 15)


@query(f"""SELECT pincode, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY pincode
           ORDER BY total DESC, pincode LIMIT 50""")
def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.updates(spark, sf_dir), ["pincode"], 50)


@query(f"""SELECT state, district, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state, district
           ORDER BY total DESC, state, district LIMIT 20""")
def rank_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.updates(spark, sf_dir), ["state", "district"], 20)


@query(f"""SELECT state, district, {SGN_SUMS}, {big(SGN, 'total')} FROM signups GROUP BY state, district
           ORDER BY total DESC, state, district LIMIT 20""")
def rank_districts_signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.signups(spark, sf_dir), ["state", "district"], 20)


@query(f"""SELECT state, district, {REN_SUMS}, {big(REN, 'total')} FROM renewals GROUP BY state, district
           ORDER BY total DESC, state, district LIMIT 10""")
def top_performers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.top_performers(fixtures.renewals(spark, sf_dir), ["state", "district"])


@query(
    """
    SELECT 'top' AS side, * FROM (SELECT * FROM t ORDER BY total DESC, district LIMIT 5)
    UNION ALL SELECT 'bottom', * FROM (SELECT * FROM t ORDER BY total, district DESC LIMIT 5)""",
    t=f"SELECT district, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY district",
)
def top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollup.rollup_by(fixtures.updates(spark, sf_dir), ["district"])
    return topk.top_bottom(totals, ["district"])


@query(
    "SELECT * FROM r WHERE rank <= 5",
    t=f"SELECT state, pincode, {UPD_SUMS}, {big(UPD, 'total')} FROM updates GROUP BY state, pincode",
    r="""SELECT *, CAST(row_number() OVER (PARTITION BY state ORDER BY total DESC, pincode) AS INTEGER) AS rank
         FROM t""",
)
def top_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = rollup.rollup_by(fixtures.updates(spark, sf_dir), ["state", "pincode"])
    return topk.top_per_group(totals, "state", "total", 5, ["pincode"])


@query(f"""SELECT 'pincode' AS level, CAST(pincode AS VARCHAR) AS key, {UPD_SUMS}, {big(UPD, 'total')}
           FROM updates WHERE state = 'ASIA' AND district = 'NATION_7' GROUP BY pincode
           ORDER BY total DESC, CAST(pincode AS VARCHAR) LIMIT 15""")
def top_chart_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.drill_down(fixtures.updates(spark, sf_dir), "ASIA", "NATION_7").limit(15)


# --- several tables ------------------------------------------------------------------------


@query(
    """
    SELECT u.*, COALESCE(sgn_first, 0) AS sgn_first, COALESCE(sgn_act, 0) AS sgn_act,
           COALESCE(sgn_look, 0) AS sgn_look FROM u LEFT JOIN s USING (state, district)""",
    u=f"SELECT state, district, {UPD_SUMS}, COUNT(DISTINCT pincode) AS n_pincodes FROM updates GROUP BY state, district",
    s=f"SELECT state, district, {SGN_SUMS} FROM signups GROUP BY state, district",
)
def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return joins.entity_features(facts.demographic, facts.enrolment)


@query(
    """
    SELECT u.*, COALESCE(sgn_first, 0) AS sgn_first, COALESCE(sgn_act, 0) AS sgn_act,
           COALESCE(sgn_look, 0) AS sgn_look FROM u LEFT JOIN s USING (state, district, pincode)""",
    u=f"SELECT state, district, pincode, {UPD_SUMS} FROM updates GROUP BY state, district, pincode",
    s=f"SELECT state, district, pincode, {SGN_SUMS} FROM signups GROUP BY state, district, pincode",
)
def entity_features_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return joins.entity_features(facts.demographic, facts.enrolment, "pincode")


@query(
    "SELECT num_total, den_total, ROUND(num_total / NULLIF(den_total, 0) * 100, 2) AS pct FROM r, u",
    r=f"SELECT {big(REN, 'num_total')} FROM renewals",
    u=f"SELECT {big(UPD, 'den_total')} FROM updates",
)
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return joins.coverage_ratio(facts.biometric, facts.demographic)


@query(
    """SELECT pincode, COALESCE(num_total, 0) AS num_total, COALESCE(den_total, 0) AS den_total,
              COALESCE(ROUND(COALESCE(num_total, 0) / NULLIF(den_total, 0) * 100, 2), 0.0) AS pct
       FROM r FULL JOIN u USING (pincode)""",
    r=f"SELECT pincode, {big(SGN, 'num_total')} FROM signups GROUP BY pincode",
    u=f"SELECT pincode, {big(UPD, 'den_total')} FROM updates GROUP BY pincode",
)
def coverage_ratio_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return joins.coverage_ratio(facts.enrolment, facts.demographic, ["pincode"])


@query(
    """SELECT pincode, demo_total, COALESCE(bio_total, 0) AS bio_total, COALESCE(enrol_total, 0) AS enrol_total
       FROM u LEFT JOIN r USING (pincode) LEFT JOIN s USING (pincode)""",
    u=f"SELECT pincode, {big(UPD, 'demo_total')} FROM updates GROUP BY pincode",
    r=f"SELECT pincode, {big(REN, 'bio_total')} FROM renewals GROUP BY pincode",
    s=f"SELECT pincode, {big(SGN, 'enrol_total')} FROM signups GROUP BY pincode",
)
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.dataset_totals(fixtures.facts(spark, sf_dir), ["pincode"])


# --- profiles ------------------------------------------------------------------------------


def _profile_sql(
    fact: str, sums: str, expr: str, shares: list[str], base: tuple[str, str] | None, by: str = ""
) -> dict[str, str]:
    """SQL of a profile, globally or per region."""
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    part = f"PARTITION BY {by} " if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    percents = ", ".join(f"ROUND(SUM({m}) / NULLIF(SUM({expr}), 0) * 100, 2) AS {m}_percent" for m in shares)
    rate = f"""SELECT {key}CAST(SUM({base[1]}) AS BIGINT) AS base_total FROM {base[0]} {group}""" if base else ""
    ctes = {
        "daily": f"SELECT {key}date, {big(expr, 'total')} FROM {fact} GROUP BY {key}date",
        "numbered": f"""SELECT *, row_number() OVER ({part}ORDER BY date) AS rn,
                        COUNT(*) OVER ({'PARTITION BY ' + by if by else ''}) AS n FROM daily""",
        "trend": f"""
            SELECT {key}CASE WHEN MAX(n) > 7 AND AVG(total) FILTER (rn <= 7) > 0 THEN
                       ROUND((AVG(total) FILTER (rn > n - 7) - AVG(total) FILTER (rn <= 7))
                             / AVG(total) FILTER (rn <= 7) * 100, 2) ELSE 0.0 END AS growth_7,
                   CAST(trunc(SUM(total) / COUNT(*)) AS BIGINT) AS avg_daily,
                   MAX(total) AS peak FROM numbered {group}""",
        "peaks": f"""SELECT {key}date AS peak_date FROM (
                       SELECT *, row_number() OVER ({part}ORDER BY total DESC, date) AS p FROM daily) WHERE p = 1""",
        "base": f"""SELECT {key}COUNT(*) AS records, {big(expr, 'total')}, {sums}, {percents},
                       MIN(date) AS start_date, MAX(date) AS end_date, {PLACES}
                    FROM {fact} {group}""",
    }
    select = f"SELECT * FROM base JOIN trend {join} JOIN peaks {join}"
    if base:
        ctes["other"] = rate
        select = f"""SELECT * EXCLUDE (base_total),
                       COALESCE(ROUND(total / NULLIF(base_total, 0) * 100, 2), 0.0) AS rate
                     FROM ({select} LEFT JOIN other {join})"""
    return {"select": select, **ctes}


@query(**_profile_sql("updates", UPD_SUMS, UPD, ["upd_new", "upd_old"], None))
def profile_demographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(fixtures.updates(spark, sf_dir))


@query(**_profile_sql("renewals", REN_SUMS, REN, ["ren_done", "ren_open"], ("updates", UPD)))
def profile_biometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return profiles.profile(facts.biometric, facts.demographic)


@query(**_profile_sql("signups", SGN_SUMS, SGN, ["sgn_first", "sgn_act", "sgn_look"], ("updates", UPD)))
def profile_enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return profiles.profile(facts.enrolment, facts.demographic)


@query(**_profile_sql("updates", UPD_SUMS, UPD, ["upd_new", "upd_old"], None, "district"))
def profile_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_by(fixtures.updates(spark, sf_dir), "district")


@query(
    **_profile_sql("signups", SGN_SUMS, SGN, ["sgn_first", "sgn_act", "sgn_look"], ("updates", UPD), "pincode")
)
def profile_by_pincode(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = fixtures.facts(spark, sf_dir)
    return profiles.profile_by(facts.enrolment, "pincode", facts.demographic)


@query(
    f"""
    SELECT (SELECT COUNT(*) FROM updates) + (SELECT COUNT(*) FROM renewals) + (SELECT COUNT(*) FROM signups)
               AS total_records, {PLACES},
           COUNT(*) FILTER (date >= (SELECT MAX(date) FROM updates) - 30)
               + (SELECT COUNT(*) FROM signups WHERE date >= (SELECT MAX(date) FROM updates) - 30) AS recent_30_days,
           ROUND(COUNT(DISTINCT state) / 36.0 * 100, 4) AS coverage_percentage
    FROM updates"""
)
def kpi_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dashboard.kpi_dashboard(fixtures.facts(spark, sf_dir)), ["coverage_percentage"])


@query(
    """SELECT pincode, total, 'low_activity' AS type, 'medium' AS severity FROM t
       WHERE total < (SELECT AVG(total) FROM t) * 0.3 ORDER BY total DESC, pincode LIMIT 10""",
    t=f"SELECT pincode, {big(UPD, 'total')} FROM updates GROUP BY pincode",
)
def low_activity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.low_activity_alerts(fixtures.updates(spark, sf_dir), "pincode")


def _compare_sql(level: str, entities: list[str]) -> dict[str, str]:
    kind = "BIGINT" if level == "pincode" else "VARCHAR"
    wanted = ", ".join(f"({i}, '{e}')" for i, e in enumerate(entities))
    return {
        "select": f"""
            SELECT ord, entity, demo AS total_demographic, COALESCE(bio, 0) AS total_biometric,
                   COALESCE(enrol, 0) AS total_enrollment, CAST(trunc(demo / greatest(days, 1)) AS BIGINT) AS avg_daily,
                   trend, {'districts' if level == 'state' else 'CAST(NULL AS BIGINT) AS districts'}, pincodes,
                   COALESCE(ROUND(COALESCE(bio, 0) / NULLIF(demo, 0) * 100, 1), 0.0) AS bio_coverage_percent,
                   COALESCE(ROUND(COALESCE(enrol, 0) / NULLIF(demo, 0) * 100, 1), 0.0) AS enrollment_rate
            FROM wanted JOIN u ON TRY_CAST(entity AS {kind}) = u.{level}
            LEFT JOIN r ON r.{level} = u.{level} LEFT JOIN s ON s.{level} = u.{level}
            LEFT JOIN t ON t.{level} = u.{level}""",
        "wanted": f"SELECT CAST(ord AS INTEGER) AS ord, entity FROM (VALUES {wanted}) AS w(ord, entity)",
        "u": f"""SELECT {level}, {big(UPD, 'demo')}, COUNT(DISTINCT district) AS districts,
                        COUNT(DISTINCT pincode) AS pincodes FROM updates GROUP BY {level}""",
        "r": f"SELECT {level}, {big(REN, 'bio')} FROM renewals GROUP BY {level}",
        "s": f"SELECT {level}, {big(SGN, 'enrol')} FROM signups GROUP BY {level}",
        "c": f"SELECT {level}, date, COUNT(*) AS k FROM updates GROUP BY {level}, date",
        "n": f"""SELECT *, row_number() OVER (PARTITION BY {level} ORDER BY date) AS rn,
                        COUNT(*) OVER (PARTITION BY {level}) AS n FROM c""",
        "t": f"""SELECT {level}, COUNT(*) AS days, CASE WHEN COUNT(*) <= 1 THEN 'stable'
                   WHEN AVG(k) FILTER (rn > n - 7) > AVG(k) FILTER (rn <= 7) THEN 'increasing'
                   WHEN AVG(k) FILTER (rn > n - 7) < AVG(k) FILTER (rn <= 7) THEN 'decreasing'
                   ELSE 'stable' END AS trend FROM n GROUP BY {level}""",
    }


STATES = ["EUROPE", "NOWHERE", "ASIA", "EUROPE"]
DISTRICTS = ["NATION_7", "NATION_19"]
PINCODES = ["12", "x1", "7", "149", "1200"]


@query(**_compare_sql("state", STATES))
def compare_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.compare_entities(fixtures.facts(spark, sf_dir), "state", STATES)


@query(**_compare_sql("district", DISTRICTS))
def compare_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.compare_entities(fixtures.facts(spark, sf_dir), "district", DISTRICTS)


@query(**_compare_sql("pincode", PINCODES))
def compare_pincodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.compare_entities(fixtures.facts(spark, sf_dir), "pincode", PINCODES)
