"""Hash-chained event logs as JSON lines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sequence bigint, run_id string, event_type string, actor string, payload string, previous_sha256 string, event_sha256 string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def resume_point(log: DataFrame) -> DataFrame:
    """(run_id, sequence, event_sha256) of each run's last event."""
    last = F.max_by(F.struct("sequence", "event_sha256"), "sequence")
    return log.groupBy("run_id").agg(last.alias("e")).select("run_id", "e.sequence", "e.event_sha256")
