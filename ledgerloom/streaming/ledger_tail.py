"""An extension: the status of files, kept up from ledger rows as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.ledger import SCHEMA


def tail(spark: SparkSession, path: str) -> DataFrame:
    """New rows of a ledger table, each once."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """The latest row of each file, for output mode complete or update; state holds one row a file."""
    top = rows.groupBy("file_name").agg(F.max(F.struct("applied_at", "id", "checksum", "status")).alias("top"))
    return top.select("file_name", "top.*")


def outcomes_in_windows(rows: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Outcomes by time window; rows later than the watermark are left out."""
    return rows.withWatermark("applied_at", late).groupBy(F.window("applied_at", window), "status").agg(F.count("*").alias("n"))
