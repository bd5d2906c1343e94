"""The engine's input tables, read as Parquet, and their bindings to jobs, usage, routes and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
STATUS = {"signup": "queued", "click": "running", "error": "failed", "view": "succeeded", "purchase": "partial"}
OPERATIONS = {"A": "stt", "N": "text_extract", "R": "visual"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def mapped(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a queue of jobs."""
    e = table(spark, sf_dir, "events")
    two = F.make_dt_interval(secs=F.lit(120))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner"), mapped(F.col("event_type"), STATUS).alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("next_attempt_at"),
        (F.col("ts") + two).alias("lease_until"), (F.col("event_id") % 4).alias("attempt"), (F.col("event_id") % 7).alias("fencing_token"), F.concat(F.lit("w"), (F.col("event_id") % 5).cast("string")).alias("worker"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with orders as a spend ledger."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("job"), F.col("o_custkey").alias("owner"), mapped(F.col("l_returnflag"), OPERATIONS).alias("operation"), F.col("l_quantity").cast("decimal(14,8)").alias("reserved"),
        F.when(F.col("l_linestatus") == "F", (F.col("l_discount") * 100).cast("decimal(14,8)")).alias("estimated"), F.when(F.col("l_returnflag") == "A", (F.col("l_tax") * 1000).cast("decimal(14,8)")).alias("actual"),
        F.col("o_orderdate").alias("created_at"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("price"),
    )


def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as measured cases of routes."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("cohort"), F.concat(F.lit("R"), (F.col("user_id") % 4).cast("string")).alias("route"), F.col("value").alias("total_ms"),
        F.when(i % 997 != 0, F.col("value").cast("decimal(18,6)")).alias("total_cost"), (F.col("event_type") != "error").alias("technical_success"), F.when(i % 3 == 0, "no_recipe").otherwise("recipe").alias("analysis_status"),
        (i % 5 != 0).alias("useful"), F.when(i % 11 != 0, "reviewed").otherwise("pending").alias("review_status"), F.when(i % 50 == 0, 1).otherwise(0).alias("serious_errors"), F.when(i % 7 != 0, i % 5 == 0).alias("visual_needed"),
    )


JOBS_SQL = """SELECT event_id AS id, user_id AS owner, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'succeeded' WHEN 'purchase' THEN 'partial' END AS status,
  ts AS created_at, ts AS next_attempt_at, ts + INTERVAL 120 SECOND AS lease_until, event_id % 4 AS attempt, event_id % 7 AS fencing_token, 'w' || (event_id % 5) AS worker FROM events"""
USAGE_SQL = """SELECT l_orderkey AS job, o_custkey AS owner, CASE l_returnflag WHEN 'A' THEN 'stt' WHEN 'N' THEN 'text_extract' WHEN 'R' THEN 'visual' END AS operation, l_quantity::DECIMAL(14,8) AS reserved,
  CASE WHEN l_linestatus = 'F' THEN (l_discount * 100)::DECIMAL(14,8) END AS estimated, CASE WHEN l_returnflag = 'A' THEN (l_tax * 1000)::DECIMAL(14,8) END AS actual, o_orderdate AS created_at, l_linenumber AS line, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
ROUTES_SQL = """SELECT user_id AS case_id, event_type AS cohort, 'R' || (user_id % 4) AS route, value AS total_ms, CASE WHEN event_id % 997 <> 0 THEN value::DECIMAL(18,6) END AS total_cost, event_type <> 'error' AS technical_success,
  CASE WHEN event_id % 3 = 0 THEN 'no_recipe' ELSE 'recipe' END AS analysis_status, event_id % 5 <> 0 AS useful, CASE WHEN event_id % 11 <> 0 THEN 'reviewed' ELSE 'pending' END AS review_status,
  CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS serious_errors, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 = 0 END AS visual_needed FROM events"""
