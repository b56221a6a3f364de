"""Entity views over the star-schema tables, with a fixed mapping so that every operator has data.

Each view is a narrow ``select`` over one table, so column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Queries take the current time as a parameter; this one is inside the range of the event table.
AS_OF = datetime(2024, 1, 15, 12)
ZONE = "America/New_York"
CATEGORIES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published events: one row each, times in UTC."""
    return raw_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.concat(F.initcap("event_type"), F.expr("CASE event_id % 4 WHEN 0 THEN ' Series at Hall' WHEN 1 THEN ' Series - Hall' WHEN 2 THEN ' series' ELSE ' Club: Family Series' END")).alias("title"),
        F.col("ts").alias("start_at"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + make_interval(0, 0, 0, 0, 0, cast(value * 10 AS int), 0) END").alias("end_at"),
        F.col("event_type").alias("category"),
        F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source"),
        F.col("event_id").cast("string").alias("source_id"),
        (F.col("user_id") % 10).alias("venue_id"),
        F.col("user_id").alias("organization_id"),
        F.when(F.col("event_id") % 11 != 0, k_of()).alias("price_min"),
        F.when((F.col("event_id") % 11 != 0) & (F.col("event_id") % 3 == 0), k_of() + 15).alias("price_max"),
        (F.col("event_id") % 50 == 0).alias("featured"),
        F.lit("published").alias("status"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("https://img.example.org/"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("image_url"),
        F.expr("array_compact(array(event_type, CASE WHEN event_id % 13 = 0 THEN 'fest-a' END, CASE WHEN event_id % 39 = 0 THEN 'umbrella' END, CASE WHEN event_id % 17 = 0 THEN 'fest-b' END))").alias("tags"),
        F.col("user_id"),
        F.col("value"),
    )


def event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (event_id, category): the event's own category, and the next one in order where user_id % 3 = 0."""
    e = raw_events(spark, sf_dir).select("event_id", "event_type", "user_id")
    order = F.array(*map(F.lit, CATEGORIES))
    after = F.element_at(order, (F.array_position(order, F.col("event_type")) % len(CATEGORIES) + 1).cast("int"))
    both = F.when(F.col("user_id") % 3 == 0, F.array("event_type", after)).otherwise(F.array("event_type"))
    return e.select("event_id", F.explode(both).alias("category"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("area_id"),
        F.concat((F.col("s_suppkey") % 40 + 100).cast("string"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN ' East Main Street' WHEN 1 THEN ' E. Main St.' ELSE ' e main st, Suite 2' END")).alias("address"),
        (F.col("s_suppkey") % 100 / 1000.0 + 41.0).alias("lat"),
        (F.col("s_suppkey") % 70 / 1000.0 - 81.5).alias("lng"),
        (F.col("s_acctbal") > 0).alias("listed"),
    )


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'The ' ELSE '' END"), F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one row for each run of a scraper."""
    return raw_events(spark, sf_dir).select(
        F.col("user_id").alias("scraper"),
        F.col("ts").alias("ran_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.greatest(k_of() - 20, F.lit(0)).alias("found"),
        F.col("event_id").alias("run_id"),
    )


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("plan_id"), F.col("o_custkey").alias("owner_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("plan_status")
    )


def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("event_id"),
        F.col("l_suppkey").alias("venue_id"),
        F.col("l_shipdate").cast("timestamp").alias("start_at"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 2 HOURS")).alias("end_at"),
        (F.col("l_returnflag") == "R").alias("removed"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )


#: The same views for the SQL that checks the queries.
EVENTS_SQL = """ev AS (
  SELECT event_id AS id,
    upper(substr(event_type, 1, 1)) || substr(event_type, 2) || CASE event_id % 4 WHEN 0 THEN ' Series at Hall' WHEN 1 THEN ' Series - Hall' WHEN 2 THEN ' series' ELSE ' Club: Family Series' END AS title,
    ts AS start_at,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts + to_minutes(CAST(trunc(value * 10) AS BIGINT)) END AS end_at,
    event_type AS category, 'src' || CAST(user_id % 8 AS VARCHAR) AS source, CAST(event_id AS VARCHAR) AS source_id, user_id % 10 AS venue_id, user_id AS organization_id,
    CASE WHEN event_id % 11 <> 0 THEN CAST(regexp_extract(props, ': *([0-9]+)', 1) AS INTEGER) END AS price_min,
    CASE WHEN event_id % 11 <> 0 AND event_id % 3 = 0 THEN CAST(regexp_extract(props, ': *([0-9]+)', 1) AS INTEGER) + 15 END AS price_max,
    event_id % 50 = 0 AS featured, 'published' AS status,
    CASE WHEN event_id % 4 <> 0 THEN 'https://img.example.org/' || CAST(event_id AS VARCHAR) || '.jpg' END AS image_url,
    event_id % 13 = 0 AS fest_a, event_id % 39 = 0 AS umbrella, event_id % 17 = 0 AS fest_b, user_id, value
  FROM events)"""
BRIDGE_SQL = """ec AS (
  SELECT event_id, event_type AS category FROM events
  UNION ALL
  SELECT event_id, CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' ELSE 'click' END FROM events WHERE user_id % 3 = 0)"""
VENUES_SQL = """ve AS (
  SELECT s_suppkey AS id, s_name AS name, s_nationkey AS area_id,
    CAST(s_suppkey % 40 + 100 AS VARCHAR) || CASE s_suppkey % 3 WHEN 0 THEN ' East Main Street' WHEN 1 THEN ' E. Main St.' ELSE ' e main st, Suite 2' END AS address,
    s_suppkey % 100 / 1000.0 + 41.0 AS lat, s_suppkey % 70 / 1000.0 - 81.5 AS lng, s_acctbal > 0 AS listed
  FROM supplier)"""
RUNS_SQL = """ru AS (
  SELECT user_id AS scraper, ts AS ran_at, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    greatest(CAST(regexp_extract(props, ': *([0-9]+)', 1) AS INTEGER) - 20, 0) AS found, event_id AS run_id
  FROM events)"""
