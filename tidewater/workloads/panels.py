"""Panels derived from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.series import rollup, rollup_daily, series_panel


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(column) -> F.Column:
    """Exact sums: cents as decimals."""
    return column.cast("decimal(18,2)")


def orders_daily(spark, sf):
    """Order value per priority and day."""
    return rollup(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderdate", money(F.col("o_totalprice")))


def orders_total(spark, sf):
    """Order value per day: one long series."""
    return rollup(table(spark, sf, "orders"), [], "o_orderdate", money(F.col("o_totalprice")))


def supplier_monthly(spark, sf):
    """Net revenue per supplier and month: the number of series grows with the data."""
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return rollup(table(spark, sf, "lineitem"), ["l_suppkey"], "l_shipdate", net, "month")


def returnflag_monthly(spark, sf):
    """Net revenue per return flag and month."""
    net = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return rollup(table(spark, sf, "lineitem"), ["l_returnflag"], "l_shipdate", net, "month")


def event_readings(spark, sf):
    """Raw event values per type at microsecond timestamps: long series that grow with the data."""
    return series_panel(table(spark, sf, "events"), "ts", "value", ["event_type"])


def events_daily(spark, sf):
    value = money(F.col("value"))
    return rollup_daily(table(spark, sf, "events"), ["event_type"], "ts", value, value)


ORDERS_DAILY = """
panel AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM orders GROUP BY ALL)"""
ORDERS_TOTAL = """
panel AS (
  SELECT 'all' AS series_id, CAST(o_orderdate AS DATE) AS ts,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y
  FROM orders GROUP BY ALL)"""


def _monthly(key):
    return f"""
panel AS (
  SELECT CAST({key} AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ts,
         CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS y
  FROM lineitem GROUP BY ALL)"""


SUPPLIER_MONTHLY = _monthly("l_suppkey")
RETURNFLAG_MONTHLY = _monthly("l_returnflag")
EVENT_READINGS = """
panel AS (SELECT event_type AS series_id, ts, value AS y FROM events)"""
EVENTS_DAILY = """
panel AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS ts,
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS y, 
         CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value) AS covariate
  FROM events GROUP BY ALL)"""
