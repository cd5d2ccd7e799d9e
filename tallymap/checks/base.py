"""Registry of queries and the common SQL that states the fixture facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.sources.csv_parts import CSV_FORMAT
from tallymap.sources.exports import write_csv
from tallymap.sources.scratch import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FACT_SQL = {
    "geo": """
        SELECT c_custkey AS pincode, n_name AS district, r_name AS state
        FROM customer JOIN nation ON c_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    "updates": """
        SELECT CAST(l_shipdate AS DATE) AS date, state, district, pincode,
               CAST(CASE WHEN l_returnflag =  'N' THEN l_quantity ELSE 0 END AS BIGINT) AS upd_new,
               CAST(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END AS BIGINT) AS upd_old
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN geo ON o_custkey = pincode""",
    "renewals": """
        SELECT CAST(o_orderdate AS DATE) AS date, state, district, pincode,
               CAST(CASE WHEN o_orderstatus =  'F' THEN floor(o_totalprice / 10000) ELSE 0 END AS BIGINT) AS ren_done,
               CAST(CASE WHEN o_orderstatus <> 'F' THEN floor(o_totalprice / 10000) ELSE 0 END AS BIGINT) AS ren_open
        FROM orders JOIN geo ON o_custkey = pincode""",
    "signups": """
        SELECT CAST(ts AS DATE) AS date, state, district, pincode,
               CAST(event_type = 'signup' AS BIGINT) AS sgn_first,
               CAST(event_type IN ('click', 'purchase') AS BIGINT) AS sgn_act,
               CAST(event_type IN ('view', 'error') AS BIGINT) AS sgn_look
        FROM events JOIN geo ON user_id = pincode""",
}

UPD = "upd_new + upd_old"
REN = "ren_done + ren_open"
SGN = "sgn_first + sgn_act + sgn_look"


def big(expression: str, name: str) -> str:
    """Sum as BIGINT (the checking engine sums into a wider type)."""
    return f"CAST(SUM({expression}) AS BIGINT) AS {name}"


UPD_SUMS = f"{big('upd_new', 'upd_new')}, {big('upd_old', 'upd_old')}"
REN_SUMS = f"{big('ren_done', 'ren_done')}, {big('ren_open', 'ren_open')}"
SGN_SUMS = f"{big('sgn_first', 'sgn_first')}, {big('sgn_act', 'sgn_act')}, {big('sgn_look', 'sgn_look')}"


def with_facts(select: str, ctes: dict[str, str] | None = None) -> str:
    parts = {**FACT_SQL, **(ctes or {})}
    return "WITH " + ",\n".join(f"{n} AS ({body})" for n, body in parts.items()) + "\n" + select


def query(select: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Register a query; without SQL only its row count can be checked."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if select is not None:
            SQL[fn.__name__] = with_facts(select, ctes)
        return fn

    return register


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def through_csv(df: DataFrame, name: str) -> DataFrame:
    """Write a result as CSV into the shared folder and read it back."""
    path = fresh_path(df.sparkSession, name)
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).options(**CSV_FORMAT).csv(path)
