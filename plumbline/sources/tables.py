"""The Parquet tables, and the relations that the queries derive from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str, positive: str = "purchase") -> DataFrame:
    """(event_id, user_id, t, day, y): events with time in microseconds; y = 1 for the positive type."""
    y = F.coalesce(F.col("event_type") == positive, F.lit(False)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(MICROS).alias("t"), F.to_date("ts").alias("day"), y.alias("y"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calls: run = user_id, seq by (time, event_id), a side effect for each type."""
    effects = {"view": "read_only", "click": "write_run_artifact", "purchase": "publish", "error": "sealed_read", "signup": "pure"}
    effect = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in effects.items()], F.lit("pure"))
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(by).cast("long").alias("seq"), "event_id", "event_type", effect.alias("side_effect"), F.col("value"))
