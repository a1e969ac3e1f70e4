"""Helpers that several operators share: tables, folders, parts of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import delete_folder, importable, scratch

#: Bytes of rows that Spark hands to Python at once in `small_batches`; Spark's own limit is 64 MB, held on both sides.
BATCH_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a Python worker keeps from task to task, by name: how to drop it.
_kept: dict[str, Callable[[], None]] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`; Python workers get this repository on their path."""
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A name, not in use yet, for a folder inside the shared one. It goes when the application ends."""
    return scratch(spark, what)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder, read again: lineage ends there, and so does recomputation."""
    spark = df.sparkSession
    path = fresh_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gets Arrow batches of about BATCH_BYTES; the session's setting comes back afterwards."""
    before = spark.conf.get(_ARROW_BYTES, None)
    spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_BYTES) if before is None else spark.conf.set(_ARROW_BYTES, before)


def keeps(name: str, drop: Callable[[], None]) -> None:
    """Tell how to drop what workers keep under this name."""
    _kept[name] = drop


def keep_only(*names: str) -> None:
    """Drop what this worker, which Spark uses again, keeps for other operators."""
    for name, drop in _kept.items():
        if name not in names:
            drop()


def discard(*tables: DataFrame) -> None:
    """Delete the folders of `written` tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)


def columns(df: DataFrame) -> list[Column]:
    """All columns by name, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def in_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, `rows` rows at a time: what is made of them as Python's objects stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z alone."""
    return F.translate(text, UPPER, LOWER)


def slices(text: str, most: int = 1 << 20, at: str = " ") -> Iterator[str]:
    """The whole text in parts, each but the last of at least `most` characters and ending before a run of `at`, whole runs
    of which stay together."""
    begin = 0
    while len(text) - begin > most:
        end = text.find(at, begin + most)
        if 0 <= end == begin + most and text[end - 1] == at:  # inside a run: on to the one after it
            while text[end : end + 1] == at:
                end += 1
            end = text.find(at, end)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text
