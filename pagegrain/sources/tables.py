"""Tables, and boxes, regions and job events derived from them by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, pos, x0, y0, x1, y1, confidence, provider; pos numbers a page's boxes."""
    line = table(spark, sf_dir, "lineitem")
    out = line.select(
        F.expr("l_orderkey div 15").alias("page"),
        F.expr("(l_partkey * 37) % 900").alias("x0"),
        F.expr("(l_suppkey * 53 + l_linenumber * 17) % 700").alias("y0"),
        F.expr("cast(20 + 3 * int(l_quantity) as bigint)").alias("w"),
        F.expr("cast(8 + 2 * l_linenumber as bigint)").alias("h"),
        F.expr("cast(round(l_discount * 100) as bigint)").alias("confidence"),
        F.col("l_returnflag").alias("provider"),
    )
    order = Window.partitionBy("page").orderBy("x0", "y0", "w", "h", "confidence", "provider")
    return out.select("page", F.row_number().over(order).cast("long").alias("pos"), "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "confidence", "provider")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, region, x0, y0, x1, y1."""
    orders = table(spark, sf_dir, "orders")
    out = orders.select(F.expr("o_orderkey div 15").alias("page"), F.col("o_orderkey").alias("region"), F.expr("(o_custkey * 41) % 800").alias("x0"), F.expr("(o_orderkey * 29) % 600").alias("y0"))
    return out.select("*", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 150).alias("y1"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job, ts, event_id, status, progress."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("job"), "ts", "event_id", F.col("event_type").alias("status"), F.least(F.lit(100), F.floor(F.col("value") / 5)).cast("long").alias("progress"))


#: The same tables as common table expressions for DuckDB.
BOXES = """boxes AS (
  SELECT page, row_number() OVER (PARTITION BY page ORDER BY x0, y0, w, h, confidence, provider) AS pos, x0, y0, x0 + w AS x1, y0 + h AS y1, confidence, provider
  FROM (SELECT l_orderkey // 15 AS page, (l_partkey * 37) % 900 AS x0, (l_suppkey * 53 + l_linenumber * 17) % 700 AS y0,
        CAST(20 + 3 * CAST(l_quantity AS BIGINT) AS BIGINT) AS w, CAST(8 + 2 * l_linenumber AS BIGINT) AS h, CAST(round(l_discount * 100) AS BIGINT) AS confidence, l_returnflag AS provider FROM lineitem))"""
REGIONS = "regions AS (SELECT o_orderkey // 15 AS page, o_orderkey AS region, (o_custkey * 41) % 800 AS x0, (o_orderkey * 29) % 600 AS y0, (o_custkey * 41) % 800 + 200 AS x1, (o_orderkey * 29) % 600 + 150 AS y1 FROM orders)"
EVENTS = "ev AS (SELECT user_id AS job, ts, event_id, event_type AS status, least(100, CAST(floor(value / 5) AS BIGINT)) AS progress FROM events)"
