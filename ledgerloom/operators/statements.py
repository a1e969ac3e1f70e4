"""What lint rules know at each statement: running state over a file's statements in order.

statements: (file_name, ord, kind, ...). All functions add columns or keep rows; each uses one window a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def so_far() -> WindowSpec:
    """A file's statements up to the current one."""
    return Window.partitionBy("file_name").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)


def first_of(condition: Column, *names: str) -> Column:
    """Whether the row is the first of its file with the condition and these values."""
    nth = F.row_number().over(Window.partitionBy("file_name", condition, *names).orderBy("ord"))
    return condition & (nth == 1)


def created_count(rows: DataFrame, creates: Column, name: str) -> DataFrame:
    """How many distinct names the file has created up to each statement, that one included: firsts counted, no sets kept."""
    return rows.withColumn("is_first", F.coalesce(first_of(creates, name), F.lit(False))).withColumn("created", F.count_if("is_first").over(so_far())).drop("is_first")


def latch(condition: Column) -> Column:
    """Whether the condition has held at this statement or an earlier one."""
    return F.coalesce(F.max(condition).over(so_far()), F.lit(False))


def toggle(on: Column, off: Column) -> Column:
    """Whether the last of `on` and `off` was `on`."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(so_far()), F.lit(False))


def first_hit(rows: DataFrame, hit: Column) -> DataFrame:
    """The first row with a hit of each file."""
    top = rows.where(hit).groupBy("file_name").agg(F.min("ord").alias("ord"))
    return rows.join(top, ["file_name", "ord"], "left_semi")


def needs_follow_up(rows: DataFrame, starts: Column, ends: Column, *names: str) -> DataFrame:
    """Groups whose last `starts` has no `ends` after it."""
    last = rows.groupBy("file_name", *names).agg(F.max(F.when(starts, F.col("ord"))).alias("started"), F.max(F.when(ends, F.col("ord"))).alias("ended"))
    return last.where(F.col("started").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("started"))))


def set_without(rows: DataFrame, sets: Column, resets: Column) -> DataFrame:
    """Files with a `sets` and no `resets`, in any order."""
    return rows.groupBy("file_name").agg(F.bool_or(sets).alias("was_set"), F.bool_or(resets).alias("was_reset")).where("was_set and not was_reset").select("file_name")


def seen_before(first: Column, *names: str) -> Column:
    """Whether an earlier statement of the file, of the same names, had `first`."""
    before = Window.partitionBy("file_name", *names).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(first).over(before), F.lit(False))


def not_allowed(rules: DataFrame, allowed: DataFrame) -> DataFrame:
    """(file_name, rule) pairs but those that directives allow."""
    return rules.join(allowed, ["file_name", "rule"], "left_anti")


def with_severity(violations: DataFrame, severity: DataFrame) -> DataFrame:
    """severity: (rule, severity), a row a rule at most: rules that are off go, unknown ones are errors."""
    known = violations.join(severity, "rule", "left").where(F.coalesce("severity", F.lit("error")) != "off")
    return known.withColumn("severity", F.when(F.col("severity") == "warn", "warn").otherwise("error"))


def severity_counts(violations: DataFrame, *by: str) -> DataFrame:
    return violations.groupBy(*by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def severity_totals(violations: DataFrame, by: str) -> DataFrame:
    """Errors and warnings of each `by`, and of all together in a row without one."""
    return violations.rollup(by).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def created_so_far(creates: Column, *names: str) -> Column:
    """Whether the file has created an object of the row's names, at this statement or before."""
    own = Window.partitionBy("file_name", *names).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(creates).over(own), F.lit(False))


def passed_counts(results: DataFrame) -> DataFrame:
    """results: (passed): one row (passed, failed)."""
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
