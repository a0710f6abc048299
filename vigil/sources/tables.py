"""Batch sources: parquet tables and the metric-point views over them.

The driver tables are TPC-H-like plus an ``events`` table; the detector
consumes *metric points* (source, metric_name, env, region, instance_id,
timestamp, value, seq). The two adapters below map table columns onto that
schema with plain column expressions, so Catalyst keeps column pruning and
filter pushdown all the way into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def unix_seconds_col(ts_col: str) -> F.Column:
    """Whole unix seconds of a (possibly TIMESTAMP_NTZ) column, UTC session."""
    return F.unix_seconds(F.col(ts_col).cast("timestamp"))


def metric_points_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric view M-1 over ``events``: 15 series (3 sources x 5 event types),
    one instance per user, ordered by (timestamp, event_id)."""
    return events_to_points(read_table(spark, sf_dir, "events"))


def events_to_points(ev: DataFrame) -> DataFrame:
    """The M-1 column mapping; works on batch and streaming frames."""
    bucket = F.col("user_id") % 3
    return ev.select(
        F.concat(F.lit("svc-"), bucket.cast("string")).alias("source"),
        F.col("event_type").alias("metric_name"),
        F.when(bucket == 2, "dev").otherwise("prod").alias("env"),
        F.when(bucket == 0, "eu-central-1").otherwise("us-east-1").alias("region"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("instance_id"),
        unix_seconds_col("ts").alias("timestamp"),
        F.col("value").alias("value"),
        F.col("event_id").alias("seq"),
    )


def metric_points_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger metric view over ``lineitem``: one series per supplier, value =
    extended price, ordered by (ship date, order key, line number)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("source"),
        F.lit("extendedprice").alias("metric_name"),
        F.lit("prod").alias("env"),
        F.lit("us-east-1").alias("region"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("instance_id"),
        unix_seconds_col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
