"""Change scripts in folders, as a DataFrame."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.naming import Naming
from ledgerloom.functions.sqltext import checksum
from ledgerloom.storage import exists

SCHEMA = "file_name string, file_path string, source_dir string, dir_index int, prefix string, timestamp string, description string, sort_key string, sql string, checksum string"


def scan(spark: SparkSession, folders: list[str] | list[Path], naming: Naming | None = None) -> DataFrame:
    """Scripts whose names fit, of all folders, not of folders in them; a folder that isn't there has none."""
    naming = naming or Naming()
    parts = []
    for k, folder in enumerate(map(str, folders)):
        if exists(spark, folder):
            raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.sql").select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.lit(folder).alias("source_dir"), F.lit(k).alias("dir_index"), F.col("value").alias("sql"))
            parts.append(raw)
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    rows = reduce(DataFrame.unionByName, parts).withColumn("parsed", naming.parsed(F.col("file_name"))).where("parsed is not null")
    return rows.select("file_name", "file_path", "source_dir", "dir_index", "parsed.prefix", "parsed.timestamp", "parsed.description", "parsed.sort_key", "sql", checksum(F.col("sql")).alias("checksum"))
