"""Operator 7: document quality by Bradley-Terry pairwise ranking.

Each text gives a few numbers about its words and characters. From labelled documents preference pairs are drawn, a
good one over a bad one, and weights are learnt so that the chance of preferring a over b is the logistic function of
weight . (features(a) - features(b)): logistic loss on feature differences, by Newton's method. A document's strength
is weight . features. The cut is a quantile of the training documents' strengths, the one with the fewest errors. The
score is a logistic function of the strength that is THRESHOLD at the cut.

Learning uses at most SAMPLE labelled documents, chosen by hash, and PAIRS pairs; all documents are scored, whole.
Labels, lang, source and doc_id are never inputs. Null and empty texts have features of their own (all zero) and get a
score like any. Null doc_ids count as held out. Repeated rows are scored as often as they come; repeated labels of a
document count once, contradicting ones not at all. Without labels of both kinds all scores are 0.5. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable, in_slices, keep_only, written

THRESHOLD = 0.3
SAMPLE, PAIRS = 20_000, 60_000
SEED = 11
#: Texts whose features Python holds at once.
SLICE = 500
#: Words of a stretch in which distinct ones are counted.
WINDOW = 400

FEATURES = ("distinct", "top", "again", "short_period", "upper", "marks", "mark_runs", "wordless", "digits", "length", "size", "lines")
_UPPER = np.array([chr(b).isupper() for b in range(128)] + [False] * 128)
_LETTER = np.array([chr(b).isalpha() for b in range(128)] + [True] * 128)
_DIGIT = np.array([chr(b).isdigit() for b in range(128)] + [False] * 128)
_SPACE = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])
_MARK = ~(_LETTER | _DIGIT | _SPACE)


def features(text: str | None) -> np.ndarray:
    """Shares of words: distinct, the commonest, equal to the one before, distinct in stretches of WINDOW words (a last
    one that is shorter counts by its length), without letters, each over the whole text. Of characters: upper case, marks, marks that follow the same mark, digits. Then mean length of words, log of their
    number, lines for each word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    letters, dense = max(1, counts[_LETTER].sum()), len(b) - counts[_SPACE].sum()
    counted = Counter(words)
    distinct, top = len(counted), max(counted.values())
    mark = _MARK[b]
    runs = int((mark[1:] & (b[1:] == b[:-1])).sum())
    again = sum(map(eq, words, words[1:]))
    period = (distinct if n <= WINDOW else sum(len(set(words[k : k + WINDOW])) for k in range(0, n, WINDOW))) / n
    # words without letters: their letters' places are counted by cutting at the spaces
    gap = np.flatnonzero(_SPACE[b])
    letter_sum = np.concatenate([[0], np.cumsum(_LETTER[b])])
    ends = np.append(gap, len(b))
    begins = np.append(0, gap + 1)
    full = ends > begins
    wordless = int((letter_sum[ends[full]] == letter_sum[begins[full]]).sum())
    return np.array([distinct / n, top / n, again / n, period, (counts[_UPPER].sum() / letters) ** 0.5, (mark.sum() / max(1, dense)) ** 0.5, (runs / max(1, dense)) ** 0.5, (wordless / n) ** 0.5, counts[_DIGIT].sum() / max(1, dense), min(dense / n, 40) / 10, np.log1p(n) / 10, min(1, counts[10] / n)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = (x - self.mean) / self.scale @ self.weights
        place = np.clip(self.slope * (strength - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -35, 35)
        return np.where(strength >= self.cut, np.maximum(1 / (1 + np.exp(-place)), THRESHOLD), np.minimum(1 / (1 + np.exp(-place)), THRESHOLD - 1e-9))


def learn(x: np.ndarray, good: np.ndarray) -> Ranking | None:
    """x: features of labelled documents; good: their labels. None unless there are both kinds."""
    if not good.any() or good.all():
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - mean) / scale
    rng = np.random.default_rng(SEED)
    more, less = np.flatnonzero(good), np.flatnonzero(~good)
    n = min(PAIRS, 20 * len(x))
    differences = z[rng.choice(more, n)] - z[rng.choice(less, n)]
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * n
    for _ in range(30):  # Newton steps on the pairs' logistic loss
        p = 1 / (1 + np.exp(np.clip(differences @ w, -35, 35)))
        gradient = differences.T @ p - ridge * w
        curve = (differences * (p * (1 - p))[:, None]).T @ differences + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    order = np.argsort(strength, kind="stable")
    s, g = strength[order], good[order]
    # errors if the first k count as bad: the good ones among them and the bad ones after
    errors = np.concatenate([[0], np.cumsum(g)]) + (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    best = np.flatnonzero(errors == errors.min())
    level = best[np.argmax([s[k] - s[k - 1] if 0 < k < len(s) else 0 for k in best])] / len(s)
    at = int(round(level * len(s)))
    # a third of the way up from the last one below the quantile
    cut = s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else s[at - 1] + (s[at] - s[at - 1]) / 3
    spread = np.abs(strength[good].mean() - strength[~good].mean())
    return Ranking(w, mean, scale, float(cut), 8 / max(spread, 1e-9))


def fitted(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking | None:
    """Learn from the labelled documents that are not held out: only their texts are measured."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = written(own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "label"), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["id", "label", "features"])

    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    rows = texts.mapInArrow(run, "id long, label int, features array<double>").groupBy("id").agg(F.min("label").alias("label"), F.min("features").alias("features")).orderBy("id").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("features").to_pylist(), dtype=float)
    return learn(x, rows.column("label").to_numpy() == 1)


def scores(texts: pa.Array, ranking: Ranking | None) -> np.ndarray:
    x = np.array([features(t.as_py()) for t in texts], dtype=float).reshape(-1, len(FEATURES))
    return ranking.score(x) if ranking else np.full(len(x), 0.5)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """`documents` (doc_id, text), `labels` (doc_id, quality): rows (doc_id, held_out, score, predicted)."""
    importable(documents.sparkSession)
    ranking = fitted(documents, labels)
    fields = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            s = scores(batch.column("text"), ranking)
            out = [is_held_out(d) for d in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], schema=fields)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, whose texts are predicted to be good: all of them without labels of both
    kinds. One scan, which nothing is shuffled for."""
    importable(documents.sparkSession)
    ranking = fitted(documents, labels)
    if ranking is None:
        return documents
    at = [c.lower() for c in documents.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in in_slices(batches, SLICE):
            yield batch.filter(pa.array(scores(batch.column(at).cast(pa.string()), ranking) >= THRESHOLD))

    # by place, since names may hold dots, which mapInArrow doesn't look up
    plain = documents.toDF(*(f"c{k}" for k in range(len(documents.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
