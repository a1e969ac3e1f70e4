"""What the two vector searches share: rows of numbers from Arrow, and which vectors take part.

A vector takes part if it and its id are not null and all its components are finite numbers. Vectors of unequal length
are compared as if the shorter ones went on with zeros. An id names a row: rows with a query's id are its own, and of
several rows with one id in a result the best-placed stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>) of the rows that take part."""
    found = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return found.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A list column without nulls as an n x d array of doubles, zeros after each row's end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == d).all():
        return flat.reshape(-1, d).astype(float)
    out = np.zeros((len(sizes), d))
    at = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, within] = flat
    return out


def blocks_of(folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder that all executors share, `rows` at a time."""
    store, root = fs.FileSystem.from_uri(folder)
    yield from dataset.dataset(root, filesystem=store, format="parquet", exclude_invalid_files=True).to_batches(batch_size=rows)


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to tables of about `rows` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)
