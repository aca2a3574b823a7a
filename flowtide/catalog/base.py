"""Registered queries: each with the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowtide.functions.text import time_string
from flowtide.sources.derived import EVENTS_TO_FLOWS, load_flows

#: slot width of the registered queries; the tables hold about one flow per minute
DAY = "1 day"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLOWS_CTE = (
    "flows AS (SELECT *, CAST(first_ts + to_milliseconds(dur_ms) AS TIMESTAMP) AS last_ts, "
    "date_trunc('day', first_ts) AS slot, false AS is_v6 FROM ("
    + EVENTS_TO_FLOWS.replace("{events}", "events")
    + "))"
)


def shown(df: DataFrame) -> DataFrame:
    """The compared form: times as text in ms, real numbers with six digits."""

    def one(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            return time_string(c, True).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.round(c, 6) + F.lit(0.0)).alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def ts(expr: str) -> str:
    """SQL text form of a time."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%g')"


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def with_flows(sql: str) -> str:
    sql = sql.strip()
    if sql[:5].upper() == "WITH ":
        return f"WITH {FLOWS_CTE}, {sql[5:]}"
    return f"WITH {FLOWS_CTE} {sql}"


def query(name: str, sql: str | None = None):
    """Register fn(flows) -> DataFrame."""

    def register(fn):
        QUERIES[name] = lambda spark, d: shown(fn(load_flows(spark, d)))
        if sql is not None:
            ORACLES[name] = with_flows(sql)
        return fn

    return register


def table_query(name: str, sql: str | None = None, flows_sql: bool = False):
    """Register fn(spark, table_dir) -> DataFrame."""

    def register(fn):
        QUERIES[name] = lambda spark, d: shown(fn(spark, d))
        if sql is not None:
            ORACLES[name] = with_flows(sql) if flows_sql else sql
        return fn

    return register
