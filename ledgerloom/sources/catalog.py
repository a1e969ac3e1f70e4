"""Schemas in Spark's catalog: running scripts, dumping tables as text, shadow databases."""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ledgerloom.functions.sqltext import tokens


def available(spark: SparkSession) -> bool:
    """Whether statements can be run: the session answers."""
    try:
        return spark.sql("SELECT 1").count() == 1
    except Exception:  # whatever a stopped or broken session raises
        return False


def split_script(sql: str) -> list[str]:
    """The statements of a script, without comments; semicolons inside quotes don't count."""
    out, now = [], ""
    for kind, text in tokens(sql):
        if kind == "other" and text == ";":
            out.append(now)
            now = ""
        elif kind == "comment":
            now += " "
        else:
            now += text
    return [s.strip() for s in [*out, now] if s.strip()]


def run_script(spark: SparkSession, sql: str) -> str | None:
    """Run statement after statement, up to the first that fails; its error, or None."""
    for statement in split_script(sql):
        try:
            spark.sql(statement)
        except Exception as e:  # whatever a script's statement raises is the script's error
            return next(iter(str(e).strip().splitlines()), type(e).__name__)
    return None


def dump(spark: SparkSession, database: str) -> str:
    """All tables and views of a database as statements, by name, without what differs from place to place."""
    out = []
    for table in sorted(spark.catalog.listTables(database), key=lambda t: t.name):
        if not table.isTemporary:
            text = spark.sql(f"SHOW CREATE TABLE {database}.{table.name}").first()[0]
            kept = [line for line in text.splitlines() if not line.strip().startswith(("LOCATION", "TBLPROPERTIES", "'transient_lastDdlTime'"))]
            out.append("\n".join(kept).replace(f"{database}.", "") + ";")
    return "\n\n".join(out) + "\n" if out else ""


@contextmanager
def shadow(spark: SparkSession, source: str | None = None) -> Iterator[str]:
    """A database of its own, with empty copies of the source's tables, that goes away at the end."""
    name, before = f"loom_shadow_{secrets.token_hex(4)}", spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {name}")
    try:
        for table in spark.catalog.listTables(source) if source else []:
            if table.tableType != "VIEW" and not table.isTemporary:
                spark.sql(f"CREATE TABLE {name}.{table.name} LIKE {source}.{table.name}")
        spark.sql(f"USE {name}")
        yield name
    finally:
        spark.sql(f"USE {before}")
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
