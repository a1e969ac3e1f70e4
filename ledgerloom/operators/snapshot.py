"""Schema snapshots as text: normalizing a dump, and comparing two line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a dump that say nothing about the schema.
NOISE = r"^(--|SET |SELECT pg_catalog[.]|COMMENT ON EXTENSION|[\\](un)?restrict)"


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line), pos from 0."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def normalized_lines(rows: DataFrame, key: str) -> DataFrame:
    """Without noise and trailing space; one blank line for a run of them, none at the ends."""
    kept = rows.withColumn("line", F.rtrim("line")).where(~F.col("line").rlike(NOISE))
    order, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    full = F.col("line") != ""
    kept = kept.withColumns({"before": F.lag("line").over(order), "first": F.min(F.when(full, F.col("pos"))).over(whole), "last": F.max(F.when(full, F.col("pos"))).over(whole)})
    return kept.where(F.col("pos").between(F.col("first"), F.col("last")) & (full | (F.col("before") != ""))).select(key, "pos", "line")


def normalized_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, text) of normalized lines, a line end last."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return normalized_lines(rows, key).groupBy(key).agg(F.concat(joined, F.lit("\n")).alias("text"))


def differences(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Positions at which two sequences of lines differ: (by, pos, left_line, right_line)."""
    left, right = a.select(*by, "pos", F.col("line").alias("left_line")), b.select(*by, "pos", F.col("line").alias("right_line"))
    return left.join(right, [*by, "pos"], "full_outer").where(~F.col("left_line").eqNullSafe(F.col("right_line")))
