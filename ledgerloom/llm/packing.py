"""Operator 9: packing documents into sequences, as a cutting-stock problem solved by column generation.

A document's ids, an end id last, are cut into full pieces of `capacity` ids, each a sequence of its own, and a rest.
Rests are whole otherwise. Their lengths, rounded up to a multiple of `grain`, make a histogram over at most
capacity / grain classes, whatever the corpus holds. Over it the driver solves the cutting-stock linear program: find
how often to use each pattern (how many rests of each class a sequence takes) so that all classes are used up by the
fewest sequences. Patterns are generated as the simplex method asks for them: an unbounded knapsack, by dynamic
programming over the capacity, finds the pattern of the best reduced cost for the current dual prices. The solution is
rounded down; what is left over is packed class by class, largest first.

Documents of a class are ranked by part and place; a pattern takes the next ranks of each of its classes. So each part
needs only how many documents of each class the parts before it hold, and finds its own pieces by itself. The last
step adds up lengths within each sequence (at most `capacity` rows) to place pieces without gaps.

Padding is what rounding leaves, about grain / 2 for each piece, besides the last patterns. Null and empty texts are the
end id alone. Repeated rows are packed as often as they come; null doc_ids come back null; other columns are ignored;
an empty table gives no pieces. Ids lie in files in the shared folder (see token_files), written by a scan without a
shuffle; the driver sees a row a part and the histogram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_folder
from ledgerloom.llm.token_files import NULL_ID, TokenPart, crc_of, write_tokens

CAPACITY, GRAIN = 4096, 8
#: The simplex method ends at this relative distance from the proven bound, or after so many steps.
GAP, STEPS = 2e-4, 4_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("slot", pa.int64())])


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack of the most value: (value, how many of each item). By dynamic programming over the capacity."""
    worth = np.full(capacity + 1, -1.0)
    worth[sizes] = values
    item = np.zeros(capacity + 1, dtype=int)
    item[sizes] = np.arange(len(sizes))
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=int)
    for w in range(1, capacity + 1):
        with_last = best[w - 1 :: -1] + worth[1 : w + 1]
        k = int(with_last.argmax())
        if with_last[k] > best[w - 1]:
            best[w], taken[w] = with_last[k], k + 1
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(len(sizes), dtype=np.int64), capacity
    while w > 0:
        if taken[w]:
            pattern[item[taken[w]]] += 1
            w -= taken[w]
        else:
            w -= 1
    return float(best[capacity]), pattern


def patterns_for(counts: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that every item is taken exactly once. counts: of each size, all above 0."""
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / (capacity // sizes))
    amount = inverse @ counts
    for step in range(STEPS):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + 1e-9 or amount.sum() * (1 - 1 / value) < GAP * amount.sum():
            break
        direction = inverse @ pattern
        rows = np.flatnonzero(direction > 1e-9)
        leaves = rows[(amount[rows] / direction[rows]).argmin()]
        basis[:, leaves] = pattern
        if step % 500 == 499:  # afresh, against rounding errors
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
        amount = np.maximum(inverse @ counts, 0)
    used = np.floor(amount + 1e-6).astype(np.int64)
    left = counts - basis @ used
    while (left < 0).any():  # a rounding error let a pattern in once too often
        used[np.flatnonzero((basis[left < 0] > 0).any(axis=0) & (used > 0))[0]] -= 1
        left = counts - basis @ used
    out = [(basis[:, k].copy(), int(used[k])) for k in range(m) if used[k]]
    while left.any():
        pattern, room = np.zeros(m, dtype=np.int64), capacity
        for k in range(m - 1, -1, -1):
            if left[k] and sizes[k] <= room:
                pattern[k] = min(left[k], room // sizes[k])
                room -= pattern[k] * sizes[k]
        times = int(min(left[k] // pattern[k] for k in np.flatnonzero(pattern)))
        out.append((pattern, times))
        left = left - pattern * times
    return out


@dataclass
class Plan:
    """Where the documents of each class go: for class c, entry k begins at rank starts[c][k]."""

    starts: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    first_sequence: dict[int, np.ndarray]
    first_slot: dict[int, np.ndarray]
    sequences: int

    def place(self, c: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, slot) of the documents with these ranks in class c."""
        k = np.searchsorted(self.starts[c], ranks, side="right") - 1
        j, each = ranks - self.starts[c][k], self.each[c][k]
        return self.first_sequence[c][k] + j // each, self.first_slot[c][k] + j % each


def plan_for(histogram: dict[int, int], units: int) -> Plan:
    """histogram: documents of each class, a class being a length in units; units: of a whole sequence."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    entries: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    taken = dict.fromkeys(entries, 0)
    sequence = 0
    for pattern, times in patterns_for(counts, sizes, units):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            c, n = int(sizes[k]), int(pattern[k])
            entries[c].append((taken[c], n, sequence, slot))
            taken[c] += n * times
            slot += n
        sequence += times
    columns = {c: np.array(rows, dtype=np.int64).T for c, rows in entries.items()}
    return Plan(*({c: x[k] for c, x in columns.items()} for k in range(4)), sequence)


def _rests(part: TokenPart, capacity: int, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document of a part: its full pieces, what is left, and that rest's class (0: none)."""
    length = np.diff(part.offsets[:])
    full, rest = length // capacity, length % capacity
    return full, rest, -(-rest // grain)


def pack(documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """`documents` (doc_id, text): rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece."""
    spark = documents.sparkSession
    folder = fresh_folder(spark, "packing")
    manifest = write_tokens(documents, folder, tokenizer, end_id, ordered=False)
    width, count = manifest["width"], max(1, len(manifest["parts"]))
    parts = spark.createDataFrame([(p["part"], p["tokens"], p["offsets"], p["docs"], p["base"]) for p in manifest["parts"]], "part int, tokens string, offsets string, docs string, base long").repartition(count)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                full, _, kind = _rests(TokenPart(folder, row, width), capacity, grain)
                found, n = np.unique(kind[kind > 0], return_counts=True)
                found, n = np.append(found, 0), np.append(n, full.sum())  # class 0: full pieces
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(found), pa.int32()), "kind": pa.array(found, pa.int32()), "n": pa.array(n, pa.int64())})

    counted = parts.mapInArrow(classes, "part int, kind int, n long")
    # at most capacity / grain rows come to the driver
    histogram = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    plan = plan_for({c: n for c, n in histogram.items() if c}, capacity // grain)
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n"))
    bases = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("kind", "before"))).alias("bases"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, bases = TokenPart(folder, row, width), dict(row["bases"])
                full, rest, kind = _rests(part, capacity, grain)
                sequence, slot = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                order = np.argsort(kind, kind="stable")
                found, first = np.unique(kind[order], return_index=True)
                for c, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
                    if c:
                        sequence[order[a:b]], slot[order[a:b]] = plan.place(c, bases[c] + np.arange(b - a))
                first_full = plan.sequences + bases.get(0, 0) + np.cumsum(full) - full
                rows = []
                for k in range(len(part)):
                    ids, doc = part[k], int(part.docs[k])
                    cuts = [(capacity * j, capacity, int(first_full[k]) + j, 0) for j in range(int(full[k]))]
                    if rest[k]:
                        cuts.append((capacity * int(full[k]), int(rest[k]), int(sequence[k]), int(slot[k])))
                    rows += [{"doc_id": None if doc == NULL_ID else doc, "start": start, "length": n, "ids_crc32": crc_of(ids[start : start + n]), "doc_tokens": len(ids), "sequence_id": s, "slot": at} for start, n, s, at in cuts]
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    found = parts.join(bases, "part").repartition(count).mapInArrow(pieces, PIECE)
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("slot")
