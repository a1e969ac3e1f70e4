"""Operator 10: exact search for the largest inner products, by multi-resolution segment statistics.

With M the largest norm, give each candidate x one more component sqrt(M^2 - |x|^2) and each query q a zero: then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, and the nearest are those of the largest inner product. Cut into segments, a vector
has in each a mean and a deviation (the norm of what is left without the mean). By the inequality of Cauchy and Schwarz

    q.x <= sum over segments of (length * mean(q) * mean(x) + deviation(q) * deviation(x)),

which bounds the distance from below. The bound is worked out with long segments first, then with shorter ones; only
what can still beat a query's k-th best score so far is bounded by the next level and at last compared in full. A bound
allows for rounding; the scores themselves are integer sums.

Before that each block of candidates is turned to its principal axes, which changes no inner product: where vectors
are unlike in few directions, the first segments hold nearly all there is and the bounds of long segments decide already.
Where vectors are spread evenly, only segments of two components tell enough (see README for how many survive).

Components are floor(scale * x), whole numbers; scores are exact whatever their size. A score beyond 64 bits is given as
the largest or smallest 64-bit number, ranked by its true value. See `vectors` for who takes part, unequal lengths and
repeated ids. Equal scores are ranked by vec_id. Empty tables give empty results.

Queries are written to the shared folder; each task holds one block of candidates and reads the queries in blocks, so
memory is bounded on both sides and nothing is broadcast. A task returns k rows a query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_folder, importable
from ledgerloom.llm.vectors import blocks_of, joined, matrix, usable

#: Rows with a component beyond this size are compared one by one, in Python's integers.
LARGEST = 2.0**26
CANDIDATES, QUERIES = 16_384, 512
SEGMENTS = (16, 4, 2)
#: Candidates that are compared at once to begin with.
FIRST = 64
#: Up to this share of a block, candidates are bounded one by one; beyond it all at once.
DENSE = 0.1
#: Vectors longer than this aren't turned, which would cost more than it saves.
TURNED = 512
LOW, HIGH = -(1 << 63), (1 << 63) - 1

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])


def statistics(x: np.ndarray, length: int) -> np.ndarray:
    """Rows whose inner products bound those of x from above: means and deviations of segments of this length."""
    n, d = x.shape
    parts = []
    for k in range(0, d, length):
        s = x[:, k : k + length]
        mean = s.mean(axis=1)
        parts += [mean * np.sqrt(s.shape[1]), np.sqrt(((s - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(parts, axis=1) if parts else np.zeros((n, 0))


def axes(x: np.ndarray) -> np.ndarray:
    """The principal axes of the rows, the one with the most first."""
    d = x.shape[1]
    if d > TURNED or len(x) < 2:
        return np.eye(d)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers up to LARGEST with one query, as whole numbers."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * max(1, x.shape[1]) < 2.0**53:
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of the highest scores, each once, with its highest; ties by id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    while True:
        some = ids[: 4 * k]
        _, first = np.unique(some, return_index=True)
        if len(first) >= k or len(some) == len(ids):
            first = np.sort(first)[:k]
            return some[first], scores[first]
        # more than 3k rows of repeated ids at the top: each id's first row alone
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)
        ids, scores = ids[first], scores[first]


class Block:
    """Candidates, all within LARGEST, with the statistics of their segments."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.axes = ids, x, axes(x)
        turned = x @ self.axes
        self.levels = [(n, statistics(turned, n)) for n in SEGMENTS]
        self.largest = np.sqrt((x**2).sum(axis=1).max(initial=0.0))
        self.alike = len(np.unique(ids)) < len(ids)
        #: Pairs of queries and candidates, and how many are left after each level's bounds.
        self.alive = np.zeros(1 + len(SEGMENTS), np.int64)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query_id, vec_ids, scores): the k best of the block for each query."""
        ids, x = self.ids, self.x
        turned = q @ self.axes
        own = ids[None, :] == query_ids[:, None]
        self.alive[0] += own.size - own.sum()
        coarse = statistics(turned, self.levels[0][0]) @ self.levels[0][1].T
        # rounding: of sums of d products of this size at most
        slack = 1e-12 * (1 + np.sqrt((q**2).sum(axis=1)) * self.largest)
        begin = np.full(len(q), -np.inf)
        alive = ~own
        for level, (length, stats) in enumerate(self.levels):
            fine = statistics(turned, length)
            bound = coarse if not level else fine @ stats.T if alive.mean() > DENSE else None
            if bound is not None and not self.alike:
                # exact scores of those that the bound puts first raise the threshold
                m = min(len(ids), FIRST)
                for j, first in enumerate(np.argpartition(np.where(alive, -bound, np.inf), m - 1, axis=1)[:, :m] if m else ()):
                    first = first[~own[j, first]]
                    if len(first) >= k:
                        begin[j] = max(begin[j], np.partition(_exact(q[j], x[first]), len(first) - k)[len(first) - k])
            last = level == len(self.levels) - 1
            for j in range(len(q)):
                some = np.flatnonzero(alive[j])
                near = stats[some] @ fine[j] if bound is None else bound[j, some]
                kept = near >= begin[j] - slack[j]
                if not last:
                    alive[j, some] = kept
                elif kept.any():
                    yield (int(query_ids[j]), *self.compared(q[j], some[kept], near[kept], begin[j], slack[j], k))
            if not last:
                self.alive[1 + level] += alive.sum()

    def compared(self, q: np.ndarray, some: np.ndarray, bound: np.ndarray, least: float, slack: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of `some`, compared in full in the order of their bounds, until no other can be one of them."""
        order = np.argsort(-bound, kind="stable")
        some, bound = some[order], bound[order]
        ids, scores, at, step = self.ids[:0], np.empty(0, np.int64), 0, FIRST
        while at < len(some) and bound[at] >= least - slack:
            part = some[at : at + step]
            ids, scores = _best(np.concatenate([ids, self.ids[part]]), np.concatenate([scores, _exact(q, self.x[part])]), k)
            if len(ids) == k:
                least = max(least, scores[-1])
            at, step = at + len(part), 2 * step
        self.alive[len(self.levels)] += at
        return ids, scores


def _whole(x: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of doubles of any size."""
    return [math.floor(Fraction(float(v)) * Fraction(scale)) for v in x]


def _beyond(score: int) -> bytes | None:
    """For scores at the ends of 64 bits or beyond, bytes in the order of their size; 2 * (8 + 1024) bits and more hold
    products of doubles."""
    return None if LOW < score < HIGH else (score + (1 << 2399)).to_bytes(300, "big")


def _row(query: int, vec: int, score: int) -> dict:
    return {"query_id": query, "vec_id": vec, "score": min(HIGH, max(LOW, score)), "beyond": _beyond(score)}


def search(embeddings: DataFrame, is_query: Column, k: int, scale: float = 256, vector: str = "embedding") -> DataFrame:
    """The k best candidates of each query among all rows but its own: (query_id, rank from 1, vec_id, score)."""
    spark = embeddings.sparkSession
    importable(spark)
    every = usable(embeddings, vector)
    folder = fresh_folder(spark, "queries")
    every.where(is_query).write.parquet(folder)
    d = every.agg(F.max(F.size("vector"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in joined(batches, CANDIDATES):
            raw = matrix(table.column("vector"), d) + 0.0
            # of an id's rows all stay, equal ones once
            keys = np.column_stack([table.column("vec_id").to_numpy(), raw.view(np.int64)]) if d else table.column("vec_id").to_numpy()[:, None]
            _, kept = np.unique(keys, axis=0, return_index=True)
            ids, raw = table.column("vec_id").to_numpy()[np.sort(kept)], raw[np.sort(kept)]
            wide = (np.abs(raw) > LARGEST / scale).any(axis=1)
            block = Block(ids[~wide], np.floor(raw[~wide] * scale))
            large = [(int(i), _whole(x, scale)) for i, x in zip(ids[wide], raw[wide])]
            for asked in blocks_of(folder, QUERIES):
                query_ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("vector"), d)
                wide_q = (np.abs(q) > LARGEST / scale).any(axis=1)
                rows = []
                if len(block.ids) and not wide_q.all():
                    for query, vecs, scores in block.search(query_ids[~wide_q], np.floor(q[~wide_q] * scale), k):
                        rows += [_row(query, int(v), int(s)) for v, s in zip(vecs, scores)]
                for j, query in enumerate(query_ids.tolist()):
                    # large numbers on either side: each pair in Python's integers, the k best ids of each query
                    if wide_q[j] or large:
                        mine = _whole(q[j], scale)
                        others = large + ([(int(i), [int(v) for v in x]) for i, x in zip(block.ids, block.x)] if wide_q[j] else [])
                        best: dict[int, int] = {}
                        for vec, x in others:
                            if vec != query:
                                score = sum(a * b for a, b in zip(mine, x))
                                best[vec] = max(score, best.get(vec, score))
                        rows += [_row(query, v, s) for v, s in sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    found = every.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "beyond")).alias("top")).select("query_id", "vec_id", "top.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
