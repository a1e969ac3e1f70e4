"""The append-only ledger: who is latest, what was there before, status and decisions.

ledger: (file_name, checksum, status, applied_at, id), status one of applied, failed, skipped; files: (file_name,
checksum, ...). The latest row is the one of the largest (applied_at, id); ties on applied_at go to the later id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = ("applied_at", "id", "checksum", "status")


def latest(ledger: DataFrame) -> DataFrame:
    """One row a file, by a partial maximum of structs: no sort, no window."""
    top = ledger.groupBy("file_name").agg(F.max(F.struct(*_ROW)).alias("top"))
    return top.select("file_name", *(F.col(f"top.{c}").alias(c) for c in _ROW))


def past_checksums(ledger: DataFrame) -> DataFrame:
    """Distinct (file_name, checksum) of all rows but the latest of each file."""
    newest = latest(ledger).select("file_name", F.col("id").alias("newest"))
    return ledger.join(newest, "file_name").where(F.col("id") != F.col("newest")).select("file_name", "checksum").distinct()


def status_of(current: Column) -> Column:
    """pending without a ledger row; else failed, skipped, changed or applied."""
    return F.when(F.col("status").isNull(), "pending").when(F.col("status").isin("failed", "skipped"), F.col("status")).when(~F.col("ledger_checksum").eqNullSafe(current), "changed").otherwise("applied")


def status(files: DataFrame, ledger: DataFrame) -> DataFrame:
    newest = latest(ledger).select("file_name", "status", F.col("checksum").alias("ledger_checksum"), "applied_at")
    return files.join(newest, "file_name", "left").select("file_name", status_of(F.col("checksum")).alias("status"), "checksum", "applied_at")


def status_counts(statuses: DataFrame) -> DataFrame:
    kinds = ("applied", "pending", "failed", "skipped", "changed")
    return statuses.agg(*(F.count_if(F.col("status") == k).alias(k) for k in kinds), F.count("*").alias("total"))


def regressions(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose checksum is one that they had before their latest row."""
    return files.join(past_checksums(ledger), ["file_name", "checksum"], "left_semi")


def decisions(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files: (file_name, checksum, editable): what applying does to each, the first case that holds."""
    newest = latest(ledger).select("file_name", F.col("checksum").alias("ledger_checksum"), "status")
    past = past_checksums(ledger).withColumn("was", F.lit(True))
    known = files.join(newest, "file_name", "left").join(past, ["file_name", "checksum"], "left")
    same = F.col("checksum").eqNullSafe(F.col("ledger_checksum"))
    action = (
        F.when(F.col("status").isNull(), "execute")
        .when(F.col("status") == "skipped", "skip")
        .when((F.col("status") == "failed") & F.col("editable"), "retry")
        .when(F.col("status") == "failed", "unresolved-failure")
        .when(same, "unchanged")
        .when(F.col("was"), "ancestor-revert")
        .when(F.col("editable"), "re-apply")
        .otherwise("tampering")
    )
    return known.select("file_name", action.alias("action"))


def pending(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files without any applied or skipped row."""
    return files.join(ledger.where(F.col("status").isin("applied", "skipped")), "file_name", "left_anti")


def history(ledger: DataFrame) -> DataFrame:
    """All rows of each file as one ordered array."""
    return ledger.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("applied_at", "id", "status", "checksum"))).alias("records"))
