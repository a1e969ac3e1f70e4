"""Operator 8: repeated passages by the suffixes that begin at minimisers, compared window by window.

A text is a sequence of words (A-Z folded to lower case; only words count, not the space between). A window is LEAST
words in a row; of its LEAST - GRAM + 1 runs of GRAM words the least by hash, the rightmost of equals, is its minimiser.
It depends on the window's words alone, so equal windows have equal minimisers at the same place inside. A word is
repeated if a window that holds it is that of an earlier (doc_id, place) too: exactly what comparing all pairs gives.

1. A scan gives each document's minimisers; those whose run occurs once in the corpus go. Windows that occur again at
   most LEAST words after themselves (texts that go round in circles) are repeats already: their stretches are noted
   with their extent, and only the first window of each such chain goes on.
2. For the rest, the hashes of the windows of each minimiser are taken from the texts.
3. They are dealt out by run and taken in the order of document and place: a window seen before is a repeat.
4. A run with more than STRETCH suffixes is dealt out to several shares by document and place. Each finds repeats by
   itself and hands on the windows it met first, packed to as many parts, by window, as there are shares; a part has one
   row from each share and finds the repeats among them.

The windows' extents meet, so a long passage is covered by several that overlap; they are merged. The copy in the
smallest doc_id (then the smallest place) stays: every word that goes has an earlier copy that does not.

Null doc_ids take no part; rows with the same doc_id are one document, which doesn't repeat itself at the same place.
Passages repeated within a document count. Empty, null and short texts have no passages; texts are read whole; an empty
table gives an empty result. Other columns go through `without_repeats` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import columns, importable, in_slices, written
from ledgerloom.llm.shingles import mixed, windows, word_hashes, words_of

LEAST, GRAM = 50, 20
#: Texts that Python holds at once, beside the Arrow batch that brings them.
SLICE = 500
#: Suffixes of one run that a share gets, about.
STRETCH = 2000


def _least(runs: np.ndarray, span: int) -> np.ndarray:
    """For each window the place of its least run, the rightmost of equals; none in texts shorter than a window."""
    if len(runs) < span:
        return np.empty(0, np.int64)
    # the window's least by doubling; place breaks ties
    low, at = runs.copy(), np.arange(len(runs))
    width = 1
    while width < span:
        step = min(width, span - width)
        other, other_at = low[step:], at[step:]
        low, at = low[: len(other)], at[: len(other)]
        take = other <= low
        low, at = np.where(take, other, low), np.where(take, other_at, at)
        width += step
    return at


def minimisers(hashes: np.ndarray, gram: int = GRAM, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(places, run hashes) of the runs that are the least, the rightmost of equals, in some window."""
    runs = windows(hashes, gram)
    places = np.unique(_least(runs, least - gram + 1))
    return places, runs[places]


def _windows(runs: np.ndarray) -> np.ndarray:
    """One hash for each window, from the hashes of runs that cover it."""
    n, covered = len(runs) - (LEAST - GRAM), [*range(0, LEAST - GRAM, GRAM), LEAST - GRAM]
    out = np.full(max(0, n), LEAST, np.uint64)
    for k in covered if n > 0 else ():
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + runs[k : k + n])
    return out


def circular(found: np.ndarray) -> np.ndarray:
    """Which windows, by their hashes, occur at most LEAST words before, too."""
    order = np.argsort(found, kind="stable")
    again = (found[order[1:]] == found[order[:-1]]) & (order[1:] - order[:-1] <= LEAST)
    out = np.zeros(len(found), bool)
    out[order[1:][again]] = True
    return out


_ANCHOR = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("gram", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int32())])
ANCHOR = "doc_id long, place int, gram long, low int, high int, n int"


def anchors_of(text: str | None) -> tuple[np.ndarray, ...]:
    """place, run hash, low, high, n: minimisers (n = 0), with how far before them their windows begin; and the
    stretches of n words that are repeats in circular texts."""
    runs = windows(word_hashes(words_of(text)).astype(np.uint64), GRAM)
    at = _least(runs, LEAST - GRAM + 1)
    places, first = np.unique(at, return_index=True)
    last = np.append(first[1:], len(at)) - 1
    grams, n = runs[places].view(np.int64), np.zeros(len(places), np.int64)
    low, high = places - last, places - first
    if len(np.unique(grams)) < len(grams) and (again := circular(_windows(runs))).any():
        going = np.isin(places, at[~again])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
        begin, end = edges[::2], edges[1::2]
        zero = np.zeros(len(begin), np.int64)
        places, grams = np.concatenate([places[going], begin]), np.concatenate([grams[going], zero])
        low, high = np.concatenate([low[going], zero]), np.concatenate([high[going], zero])
        n = np.concatenate([n[going], end - 1 - begin + LEAST])
    return places, grams, low, high, n


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, SLICE):
        docs, rows = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            rows.append(anchors_of(text.as_py()))
            docs.append(np.full(len(rows[-1][0]), doc, np.int64))
        if docs:
            columns = [np.concatenate(docs), *(np.concatenate(c) for c in zip(*rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, _ANCHOR.types)], schema=_ANCHOR)


_SUFFIX = pa.schema([("gram", pa.int64()), ("share", pa.int32()), ("shares", pa.int32()), ("windows", pa.binary()), ("doc_id", pa.int64()), ("start", pa.int32())])
SUFFIX = "gram long, share int, shares int, windows binary, doc_id long, start int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of the wanted minimisers, the first of which begins at `start`."""
    for batch in in_slices(batches, SLICE):
        rows = []
        for doc, text, anchors in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("anchors")):
            runs = windows(word_hashes(words_of(text.as_py())).astype(np.uint64), GRAM)
            grams, whole = runs.view(np.int64), _windows(runs)
            for a in anchors.as_py():
                k = a["place"]
                if k < len(grams) and grams[k] == a["gram"]:
                    rows.append({"gram": a["gram"], "share": a["share"], "shares": a["shares"], "windows": whole[k - a["high"] : k - a["low"] + 1].tobytes(), "doc_id": doc, "start": k - a["high"]})
            if len(rows) > 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=_SUFFIX)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SUFFIX)


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("first_doc", pa.int64()), ("gram", pa.int64()), ("part", pa.int32()), ("firsts", pa.binary())])
FOUND = "doc_id long, start int, n int, first_doc long, gram long, part int, firsts binary"


def _handed_on(gram: int, shares: int, seen: dict[int, tuple[int, int]]) -> Iterator[dict]:
    """The windows that a share of a split run met first, by part: three numbers each (window, document, place)."""
    rows = np.array([(w, d, k) for w, (d, k) in seen.items()], dtype=np.int64).reshape(-1, 3)
    part = mixed(rows[:, 0].view(np.uint64)) % np.uint64(shares)
    for p in np.unique(part):
        yield {"gram": gram, "part": int(p), "firsts": rows[part == p].tobytes()}


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the suffixes of a run's share, in order; of runs that are split also the windows met first, packed."""
    of, many, seen = None, 1, {}
    for batch in batches:
        out = []
        for gram, share, shares, raw, doc, start in zip(*(c.to_pylist() for c in batch.columns)):
            if (gram, share) != of:
                if many > 1:
                    out += _handed_on(of[0], many, seen)
                of, many, seen = (gram, share), shares, {}
            again, firsts = [], []
            for k, window in enumerate(np.frombuffer(raw, np.int64).tolist(), start):
                first = seen.setdefault(window, (doc, k))
                if first != (doc, k):
                    again.append(k)
                    firsts.append(first[0])
            if again:
                out.append({"doc_id": doc, "start": again[0], "n": again[-1] - again[0] + LEAST, "first_doc": min(firsts)})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_FOUND)
    if many > 1:
        yield pa.RecordBatch.from_pylist(list(_handed_on(of[0], many, seen)), schema=_FOUND)


_MORE = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("first_doc", pa.int64())])


def _between_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the windows that the shares of a run met first: rows of (gram, part) come one after another."""
    of, held = None, []

    def found() -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, 3)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.append(True, rows[1:, 0] != rows[:-1, 0])
        first = rows[np.flatnonzero(new)[np.cumsum(new) - 1], 1]
        again = ~new
        yield pa.RecordBatch.from_arrays([pa.array(rows[again, 1]), pa.array(rows[again, 2].astype(np.int32)), pa.array(np.full(again.sum(), LEAST, np.int32)), pa.array(first[again])], schema=_MORE)

    for batch in batches:
        for gram, part, firsts in zip(batch.column("gram").to_pylist(), batch.column("part").to_pylist(), batch.column("firsts")):
            if (gram, part) != of:
                if held:
                    yield from found()
                of, held = (gram, part), []
            held.append(firsts.as_py())
    if held:
        yield from found()


def repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n, first_doc): passages, in words, all of which are in earlier places too; first_doc: the
    smallest document of those where their windows come first."""
    importable(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    scanned = written(docs.mapInArrow(_anchors, ANCHOR), "minimisers")
    anchors = scanned.where("n = 0").drop("n")
    # a table of its own, so that both sides of the join are dealt out anew and a frequent run's rows can be split
    twice = written(anchors.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1"), "frequent")
    shares = F.ceil(F.col("held") / STRETCH)
    dealt = anchors.join(twice, "gram").select("doc_id", F.struct("place", "gram", "low", "high", F.pmod(F.xxhash64("doc_id", "place"), shares).cast("int").alias("share"), shares.cast("int").alias("shares")).alias("anchor"))
    wanted = dealt.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    suffixes = docs.join(wanted, "doc_id").select("doc_id", "text", "anchors").mapInArrow(_suffixes, SUFFIX)
    found = written(suffixes.repartition("gram", "share").sortWithinPartitions("gram", "share", "doc_id", "start").mapInArrow(_neighbours, FOUND), "repeats")
    handed_on = found.where("part is not null").select("gram", "part", "firsts").repartition("gram", "part").sortWithinPartitions("gram", "part")
    more = handed_on.mapInArrow(_between_shares, "doc_id long, start int, n int, first_doc long")
    names = ("doc_id", "start", "n", "first_doc")
    within = scanned.where("n > 0").select("doc_id", F.col("place").alias("start"), "n", F.col("doc_id").alias("first_doc"))
    return within.union(found.where("part is null").select(*names)).union(more)


def passages(documents: DataFrame) -> DataFrame:
    """Repeats merged: rows (doc_id, start, n, first_doc_id), one for each stretch of a document's repeated words."""
    found = repeats(documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "n", "first_doc"))).alias("all"))
    merged = F.expr("""
        aggregate(all, cast(array() as array<struct<start: int, stop: int, first_doc: bigint>>), (done, x) ->
            if(size(done) > 0 and element_at(done, -1).stop >= x.start,
               concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, x.start + x.n), 'first_doc', least(element_at(done, -1).first_doc, x.first_doc)))),
               concat(done, array(named_struct('start', x.start, 'stop', x.start + x.n, 'first_doc', x.first_doc)))))
    """)
    return found.select("doc_id", F.explode(merged).alias("p")).select("doc_id", F.col("p.start").cast("long").alias("start"), (F.col("p.stop") - F.col("p.start")).cast("long").alias("n"), F.col("p.first_doc").alias("first_doc_id"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, n), which don't overlap, and the space before each."""
    bounds = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, n in sorted(spans):
        if start >= len(bounds):
            break
        begin = bounds[start - 1][1] if start else 0
        out.append(text[at:begin])
        at = bounds[min(start + n, len(bounds)) - 1][1]
    out.append(text[at:])
    return "".join(out)


def without_repeats(documents: DataFrame) -> DataFrame:
    """`documents`, all columns, with repeated passages cut out of the texts; n_chars, where there is one, follows."""
    spans = passages(documents).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    @F.pandas_udf("string")
    def trimmed(texts, spans):
        import pandas as pd

        return pd.Series([t if s is None or t is None else cut(t, [(x["start"], x["n"]) for x in s]) for t, s in zip(texts, spans)])

    # rows go along as one struct, so no name of theirs can clash
    rows = documents.select(F.struct(*columns(documents)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(spans, "doc_id", "left").withColumn("cut", F.when(F.col("spans").isNotNull(), trimmed(F.when(F.col("spans").isNotNull(), F.col("text")), "spans")))
    row = F.col("row").withField("text", F.col("cut").cast(documents.schema["text"].dataType))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("cut").cast(documents.schema["n_chars"].dataType))
    return found.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")
