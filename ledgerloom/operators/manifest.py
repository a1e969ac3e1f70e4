"""Reconciling files with the manifest of what should exist.

files: (file_name, checksum, sort_key, dir_index); manifest: (file, checksum).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recorded(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest, files["file_name"] == manifest["file"], "left_semi")


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return files.join(manifest, files["file_name"] == manifest["file"], "left_anti")


def missing(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(files, files["file_name"] == manifest["file"], "left_anti")


def mismatches(files: DataFrame, manifest: DataFrame, editable: DataFrame) -> DataFrame:
    """Recorded files of another checksum that may not be edited; an empty recorded checksum is not held against."""
    expected = manifest.select(F.col("file").alias("file_name"), F.col("checksum").alias("expected"))
    both = files.join(expected, "file_name").where((F.col("checksum") != F.col("expected")) & (F.col("expected") != ""))
    return both.join(editable, "file_name", "left_anti").select("file_name", F.substring("expected", 1, 12).alias("expected"), F.substring("checksum", 1, 12).alias("actual"))


def mid_sequence(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """New files that sort before the last recorded one."""
    last = recorded(files, manifest).agg(F.max("sort_key").alias("last_key"))
    return new_files(files, manifest).join(F.broadcast(last), F.col("sort_key") < F.col("last_key")).select("file_name", "sort_key", "last_key")


def tail(files: DataFrame, *by: str) -> DataFrame:
    """The last file in order, of all or of each group."""
    return files.groupBy(*by).agg(F.max(F.struct("sort_key", "dir_index", "file_name")).alias("top")).select(*by, F.col("top.file_name").alias("file_name"))


def first_reason(*sets: tuple[DataFrame, str]) -> DataFrame:
    """Union of (file_name) sets in order of priority: each file with the first reason that names it."""
    rows = None
    for priority, (df, reason) in enumerate(sets):
        one = df.select("file_name", F.struct(F.lit(priority).alias("priority"), F.lit(reason).alias("reason")).alias("why"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("file_name").agg(F.min("why").alias("why")).select("file_name", F.col("why.reason").alias("reason"))


def several_new(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """All new files, if there are more than one."""
    new = new_files(files, manifest)
    total = new.agg(F.count("*").alias("new_count")).where("new_count > 1")
    return new.select("file_name").join(F.broadcast(total))


def put(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows, or replace those of the same file."""
    return manifest.join(rows, "file", "left_anti").unionByName(rows.select(*manifest.columns))


def remove(manifest: DataFrame, file: str | Column) -> DataFrame:
    return manifest.where(~F.col("file").eqNullSafe(F.lit(file)))


def before_boundary(model: str | None, since: str | None, file: Column) -> Column:
    """Whether a file belongs to the time before the boundary; true without one."""
    return F.lit(True) if not model or not since else file < F.lit(since)


def squashed(files: DataFrame, group: str = "component") -> DataFrame:
    """Groups of two files or more, descriptions and bodies joined in order. files: (group, file_name, sort_key, description, sql)."""
    ordered = F.array_sort(F.collect_list(F.struct("sort_key", "file_name", "description", "sql")))
    body = lambda x: F.concat(F.lit("-- Source: "), x["file_name"], F.lit("\n"), x["sql"])
    rows = files.groupBy(group).agg(ordered.alias("all")).where(F.size("all") >= 2)
    return rows.select(group, F.array_join(F.transform("all", lambda x: x["description"]), "_and_").alias("description"), F.array_join(F.transform("all", body), "\n\n").alias("sql"), F.size("all").cast("long").alias("n_files"))
