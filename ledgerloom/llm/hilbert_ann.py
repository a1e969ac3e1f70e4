"""Operator 5: approximate nearest neighbours by shifted space-filling curves.

Nearness is the inner product. With M the largest norm, each candidate x gets one more component sqrt(M^2 - |x|^2) and
each query, scaled to the norm M, a zero: the nearest by distance then have the largest inner product. For each of
several curves the vectors are rotated at random, projected to a few dimensions, scaled by quantiles, shifted at
random, and put in the order of a Hilbert curve. Each order is range-partitioned into blocks by key; a query visits
its own block and the neighbouring ones. What the visits find is merged and ranked by the exact product in double
precision.

Rotations come from a seed; quantiles and block bounds from SAMPLE vectors, chosen by hash. All vectors are indexed.
Equal vectors share one entry, with the smallest ids: the k + 1 smallest are all that any result can use, so no group of
copies makes a block large, and equal queries are searched once. A block with more than BLOCK_ROWS rows expected is
split by hashed id, and its queries visit all its parts; where more than QUERY_ROWS queries are expected to visit a block,
they are split likewise, and each part of the queries meets all parts of the block.

How wide the window must be depends on the data: where vectors are spread evenly in 64 dimensions, as in the supplied
tables, near ones are close on no curve, and only a wide one reaches a recall of 0.9 (see README for measurements).

Vectors null, zero, or with null or non-finite components take no part; see `vectors` for unequal lengths and repeated
ids. Equal scores are ranked by vec_id. Empty tables give empty results; with few rows all that are found is returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable, written
from ledgerloom.llm.vectors import matrix, usable

SEED = 20
#: Vectors that quantiles and block bounds are fitted on, at most.
SAMPLE = 8000
CURVES, DIMENSIONS, BITS = 12, 6, 5
#: Blocks of each curve, and how many neighbours a query visits on either side.
BLOCKS, REACH = 20, 1
BLOCK_ROWS, QUERY_ROWS = 50_000, 20_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n x d, each below 2^bits), by undoing its rotations bit by bit."""
    x = cells.astype(np.int64).T.copy()
    d, n = x.shape
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


class Curves:
    """Fitted on a sample: the block of each curve that a vector lies in."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, dimensions: int, bits: int, blocks: int) -> None:
        rng = np.random.default_rng(SEED)
        d = sample.shape[1] + 1
        self.largest, self.bits = largest, bits
        self.axes = [np.linalg.qr(rng.normal(size=(d, d)))[0][:, : min(dimensions, d)] for _ in range(curves)]
        self.shifts = [rng.random(a.shape[1]) for a in self.axes]
        lifted = self.lift(sample, query=False)
        self.steps = [np.quantile(lifted @ a, np.linspace(0, 1, 257), axis=0) for a in self.axes]
        self.bounds = [np.quantile(self.keys(lifted, c), np.linspace(0, 1, blocks + 1)[1:-1]) for c in range(curves)]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        size = np.sqrt((x**2).sum(axis=1))
        if query:
            return np.column_stack([x * (self.largest / size)[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.largest**2 - size**2, 0))])

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        places = lifted @ self.axes[curve]
        steps, grid = self.steps[curve], np.linspace(0, 1, 257)
        even = np.column_stack([np.interp(places[:, j], steps[:, j], grid) for j in range(places.shape[1])])
        cells = np.minimum((even + self.shifts[curve]) / 2 * (1 << self.bits), (1 << self.bits) - 1)
        return hilbert_keys(cells.astype(np.int64), self.bits)

    def blocks(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        lifted = self.lift(x, query)
        return [np.searchsorted(b, self.keys(lifted, c), side="right") for c, b in enumerate(self.bounds)]


def search(embeddings: DataFrame, is_query: Column, k: int, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, blocks: int = BLOCKS, reach: int = REACH, vector: str = "embedding") -> DataFrame:
    """The k nearest found for each query among all rows but its own: (query_id, rank from 1, vec_id, score)."""
    spark = embeddings.sparkSession
    importable(spark)
    every = usable(embeddings, vector).where(F.exists("vector", lambda x: x != 0))
    # trailing zeros don't tell vectors apart; one entry for equal vectors, with the k + 1 smallest ids
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    some = every.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    entries = written(some.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.xxhash64("vector")), "entries")
    asked = every.where(is_query).distinct().select("vec_id", "vector")
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    known = entries.agg(F.max(F.size("vector")).alias("d"), F.max(size).alias("most"), F.count("*").alias("n")).first()
    d = known.d or 0
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("vector").toArrow()
    fitted = Curves(matrix(sample.column("vector"), d), known.most, curves, dimensions, bits, blocks) if known.n else None
    shares = max(1, math.ceil((known.n or 0) / blocks / BLOCK_ROWS))

    kinds = pa.schema([("curve", pa.int32()), ("block", pa.int32()), ("share", pa.int32()), ("asks", pa.bool_()), ("ids", pa.list_(pa.int64())), ("row", pa.binary())])

    def place(batches, asks: bool):
        for batch in batches:
            x = matrix(batch.column("vector"), d)
            rows, entry = [r.tobytes() for r in x], batch.column("entry").to_numpy()
            for c, block in enumerate(fitted.blocks(x, asks)):
                for step in range(-reach, reach + 1) if asks else (0,):
                    for other in range(shares if asks else ask_shares):
                        to = block + step
                        keep = np.flatnonzero((to >= 0) & (to < blocks))
                        deal = other * ask_shares + entry[keep] % ask_shares if asks else entry[keep] % shares * ask_shares + other
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), c), pa.int32()), pa.array(to[keep], pa.int32()), pa.array(deal, pa.int32()), pa.array(np.full(len(keep), asks)), batch.column("ids").take(pa.array(keep)), pa.array([rows[i] for i in keep], pa.binary())], schema=kinds)

    def visit(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        rows = np.frombuffer(b"".join(table.column("row").to_pylist()), float).reshape(len(asks), d)
        lists = table.column("ids").to_pylist()
        there = np.flatnonzero(~asks)
        x, near = rows[there], rows[there].astype(np.float32)
        found: list[tuple[int, int, float]] = []
        for begin in range(0, int(asks.sum()) if len(there) else 0, 256):
            part = np.flatnonzero(asks)[begin : begin + 256]
            rough = rows[part].astype(np.float32) @ near.T
            m = min(len(there), k + 1)
            least = -np.partition(-rough, m - 1, axis=1)[:, m - 1]
            least -= 1e-5 * (1 + np.abs(rough).max(axis=1))
            for j, q in enumerate(part):
                some = np.flatnonzero(rough[j] >= least[j])
                score = (x[some] * rows[q]).sum(axis=1)
                order = np.argsort(-score, kind="stable")
                if len(order) > m:
                    order = order[score[order] >= score[order[m - 1]]]
                found += [(lists[q][0], vec, float(score[i])) for i in order for vec in lists[there[some[i]]]]
        query, vec, score = zip(*found) if found else ((), (), ())
        return pa.table({"asker": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})

    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal queries ask once, under their smallest id
    askers = written(asked.groupBy("vector").agg(F.min("vec_id").alias("asker")), "askers")
    ask_shares = max(1, math.ceil(askers.count() * (2 * reach + 1) / blocks / QUERY_ROWS))
    placed = "curve int, block int, share int, asks boolean, ids array<long>, row binary"
    candidates = entries.select("vector", "ids", "entry").mapInArrow(lambda b: place(b, False), placed)
    visits = askers.select("vector", F.array("asker").alias("ids"), F.xxhash64("vector").alias("entry")).mapInArrow(lambda b: place(b, True), placed)
    met = candidates.union(visits).groupBy("curve", "block", "share").applyInArrow(visit, "asker long, vec_id long, score double")
    best = met.groupBy("asker").agg(F.collect_set(F.struct((-F.col("score")).alias("less"), "vec_id")).alias("all"))
    best = best.withColumn("all", F.array_sort("all"))
    per_query = asked.join(askers, "vector").select(F.col("vec_id").alias("query_id"), "asker").join(best, "asker")
    mine = per_query.select("query_id", F.posexplode(F.slice(F.filter("all", lambda s: s["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return mine.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
