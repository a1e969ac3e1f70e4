"""Operator 6: language-model scores from a hierarchical Pitman-Yor model.

Words are drawn from restaurants: one for each context (the word before), all sharing one parent, the restaurant of
words without context, whose own parent is uniform over the V training words and one place for all others. In a
restaurant a customer (an occurrence) joins a table that serves its word with weight customers - discount * tables, or
opens one with weight (strength + discount * all tables) * parent's probability; each table is a customer of the parent.
Seating is sampled by Gibbs in blocks: a sweep seats anew all customers of a word in a restaurant, given the tables of
all others after the sweep before. Probabilities are averaged over the sweeps after the burn-in; discounts come from the
counts of counts (n1 / (n1 + 2 n2)).

How it runs: a scan cuts texts into tokens and deals (word, context, document) triples out by word to shares of some
SHARE_TOKENS tokens, packed to arrays. Words with half a share's tokens or more (found on a sample that grows with the
corpus) are dealt out by word and context. A share keeps what it was dealt in the shared folder, and seats its own words
in all restaurants. What shares have to know from each other goes by keys: the contexts, and the words that are dealt
out. Keys are hashed to pieces; a piece adds up what the shares send for its keys and sends each share the sums of the
keys that it asked for. A word that is dealt out is seated in the parent restaurant by its piece, as others are by their
share. So no task and no message holds more than shares and pieces do; there are as many pieces as shares. The driver
sees some sums.

Contexts are told apart by log2(tokens) + CONTEXT_BITS bits of the word's hash: at any size at most one context in 1024
is taken together with another one (`bits` = 64: all of the hash). Sampling is seeded by share or word and by sweep, so
a task that runs again gives the same tables; with another number of shares (tokens / SHARE_TOKENS, or Spark's shuffle
partitions if they are more) another sample is drawn, and scores differ a little.

Null and empty texts are the end token alone. Null doc_ids count as held out. Repeated rows are scored, and learnt,
as often as they come. Texts are read whole. Without training rows every word is unknown, and an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh_folder, importable, written
from ledgerloom.llm.shingles import mixed, word_hashes, words_of

SWEEPS, BURN_IN = 3, 1
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
SHARE_TOKENS = 2_000_000
CONTEXT_BITS = 10
#: Documents of the sample that words to deal out are looked for in: at least so many, and so great a part of all.
SAMPLE, SAMPLE_PART = 2000, 0.005
#: Tokens and documents of a chunk, which a scan deals out at once.
CHUNK_TOKENS, CHUNK_DOCS = 1_500_000, 60_000
BEGIN, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
NULL_ID = -(1 << 63)

Seating = Callable[[np.ndarray, np.ndarray, float, np.random.Generator], np.ndarray]


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


# arrays in rows and files


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers, none below 0, in the fewest bytes that hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & np.uint64(0xFFFFFFFF)).astype(np.uint32), _small(x >> np.uint64(32))


def _whole(halves: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return halves[0].astype(np.uint64) | halves[1].astype(np.uint64) << np.uint64(32)


def _steps(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Ascending numbers as the first one and the steps between them."""
    return (int(x[0]) if len(x) else 0), _small(np.diff(x))


def _from_steps(steps: tuple[int, np.ndarray], n: int) -> np.ndarray:
    return np.cumsum(np.concatenate([np.array([steps[0]], np.uint64), steps[1].astype(np.uint64)]), dtype=np.uint64)[:n]


def _packed(data: object) -> bytes:
    raw = pickle.dumps(data, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> object:
    return pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True))


def _store(folder: str, name: str, data: object) -> None:
    """A file of the shared folder. Its data depend on its name alone, so where a lost task's file is there already, or
    another try's comes first, that one stays."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    attempt = f"{root}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as out:
        out.write(_packed(data))
    try:
        store.move(attempt, f"{root}/{name}")
    except OSError:
        if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
            raise
        store.delete_file(attempt)


def _load(folder: str, name: str) -> object:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}") as f:
        return _unpacked(f.read())


# dealing out


@dataclass(frozen=True)
class Deal:
    """How tokens are dealt out: hashes of the words that go by word and context, numbers of shares and pieces, bits of contexts."""

    split: np.ndarray
    shares: int
    bits: int

    def share_of(self, words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        out = mixed(words ^ np.uint64(99)) % np.uint64(self.shares)
        if len(self.split):
            common = self.split[np.minimum(np.searchsorted(self.split, words), len(self.split) - 1)] == words
            out[common] = mixed(words[common] + contexts[common] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.shares)
        return out

    def contexts(self, before: np.ndarray) -> np.ndarray:
        return mixed(before) >> np.uint64(64 - self.bits)

    def piece_bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where in ascending keys of `bits` bits the keys of each piece begin, and the end."""
        edges = [-(-(k << self.bits) // self.shares) for k in range(1, self.shares)]
        return np.concatenate([[0], np.searchsorted(keys, np.array(edges, dtype=np.uint64)), [len(keys)]])


_DEALT = pa.schema([("share", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary()), ("docs", pa.binary())])


def _flush(chunk: int, words: list, contexts: list, docs: list, rows: list[tuple], deal: Deal) -> Iterator[dict]:
    w, c, d = np.concatenate(words), np.concatenate(contexts), np.concatenate(docs)
    share = deal.share_of(w, c)
    train = np.array([not r[1] for r in rows])
    order = np.lexsort((c, w, share.astype(np.uint16 if deal.shares < 1 << 16 else np.uint32)))
    w, c, d, share = w[order], c[order], d[order], share[order]
    new_word = np.ones(len(w), bool)
    new_word[1:] = (w[1:] != w[:-1]) | (share[1:] != share[:-1])
    new_type = new_word.copy()
    new_type[1:] |= c[1:] != c[:-1]
    types = np.flatnonzero(new_type)
    learnt = np.add.reduceat(train[d].astype(np.int64), types)
    seen = np.diff(np.append(types, len(w)))
    first = np.flatnonzero(new_word[types])
    bounds = np.searchsorted(share, np.arange(deal.shares + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[s], bounds[s + 1]
        ta, tb = np.searchsorted(types, (a, b))
        wa, wb = np.searchsorted(first, (ta, tb))
        data = {"words": w[types[first[wa:wb]]], "n": _small(np.diff(np.append(first[wa:wb], tb))), "contexts": _halves(c[types[ta:tb]]), "learnt": _small(learnt[ta:tb]), "seen": _small(seen[ta:tb]), "docs": _small(d[a:b])}
        yield {"share": int(s), "chunk": chunk, "payload": _packed(data), "docs": None}
    ids = {"ids": np.array([r[0] for r in rows], np.int64), "held_out": ~train, "n": np.array([r[2] for r in rows], np.int64)}
    yield {"share": chunk % deal.shares, "chunk": chunk, "payload": None, "docs": _packed(ids)}


def _deal(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    words, contexts, docs, rows, held = [], [], [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            w = np.append(word_hashes(words_of(text.as_py())).astype(np.uint64), END)
            words.append(w)
            contexts.append(deal.contexts(np.append(BEGIN, w[:-1])))
            docs.append(np.full(len(w), len(rows), np.uint16))
            rows.append((NULL_ID if doc_id is None else doc_id, is_held_out(doc_id), len(w)))
            held += len(w)
            if held >= CHUNK_TOKENS or len(rows) >= CHUNK_DOCS:
                for row in _flush(chunk, words, contexts, docs, rows, deal):
                    yield pa.RecordBatch.from_pylist([row], schema=_DEALT)
                words, contexts, docs, rows, held, chunk = [], [], [], [], 0, chunk + 1
    if rows:
        for row in _flush(chunk, words, contexts, docs, rows, deal):
            yield pa.RecordBatch.from_pylist([row], schema=_DEALT)


# the model


SUMS = ("tokens", "n1", "n2", "words", "parent_customers", "w1", "w2", "parent_tables")


@dataclass(frozen=True)
class Model:
    """Sums after each sweep so far (0: one table for each word in each restaurant), and the hyperparameters."""

    after: tuple[dict[str, float], ...]
    discount: float
    parent_discount: float
    vocabulary: float

    @staticmethod
    def begin(first: dict[str, float]) -> Model:
        rate = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b))) if a else 0.5
        return Model((first,), rate(first["n1"], first["n2"]), rate(first["w1"], first["w2"]), first["words"])

    def and_then(self, sums: dict[str, float]) -> Model:
        return Model((*self.after, sums), self.discount, self.parent_discount, self.vocabulary)

    def base(self, s: int) -> float:
        """The weight of a new table in the parent restaurant, after sweep s."""
        return (PARENT_STRENGTH + self.parent_discount * self.after[s]["parent_tables"]) / (self.vocabulary + 1)

    def above(self, s: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words without context, after sweep s, from their customers and tables in the parent restaurant."""
        return (np.maximum(customers - self.parent_discount * tables, 0) + self.base(s)) / (PARENT_STRENGTH + self.after[s]["parent_customers"])

    def within(self, learnt: np.ndarray, tables: np.ndarray, customers: np.ndarray, all_tables: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Probabilities of words in contexts with so many customers and tables."""
        return (np.maximum(learnt - self.discount * tables, 0) + (STRENGTH + self.discount * all_tables) * above) / (STRENGTH + customers)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that customers of one word come to, seated in turn; weight: of opening one. Later ones in blocks."""
    tables = (customers > 0).astype(np.int64)
    some = np.flatnonzero(customers > 1)
    some = some[np.argsort(-customers[some], kind="stable")]
    c, a, t = customers[some], weight[some], tables[some]
    n = 1
    while len(some) and (active := int(np.searchsorted(-c, -n))):
        step = 1 if n < 16 else n // 8
        opens = a[:active] / (a[:active] + n - discount * t[:active])
        t[:active] += rng.binomial(np.minimum(step, c[:active] - n), np.clip(opens, 0, 1))
        n += step
    tables[some] = t
    return tables


# what travels between shares and pieces

EXCHANGED = "share int, piece int, payload binary"
_EXCHANGED = pa.schema([("share", pa.int32()), ("piece", pa.int32()), ("payload", pa.binary())])


def _rows(found: list[tuple[int, int, object]]) -> pa.Table:
    return pa.table([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([_packed(f[2]) for f in found], pa.binary())], schema=_EXCHANGED)


class Share:
    """What one share was dealt. `types`: its (word, context) pairs, by word, then context."""

    def __init__(self, folder: str, number: int, data: dict) -> None:
        self.folder, self.number = folder, number
        self.words, self.contexts = data["words"], _from_steps(data["contexts"], data["n_contexts"])
        self.word_of = np.repeat(np.arange(len(self.words)), data["n"])
        self.context_of, self.learnt = data["context_of"].astype(np.int64), data["learnt"].astype(np.int64)

    def split(self, deal: Deal) -> np.ndarray:
        """Places of its words that are dealt out, among its words."""
        return np.flatnonzero(np.isin(self.words, deal.split))

    def parent(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word_of, weights=tables, minlength=len(self.words)).astype(np.int64)

    def messages(self, deal: Deal, tables: np.ndarray, parent_tables: np.ndarray, first: dict | None = None) -> Iterator[tuple[int, int, dict]]:
        """For each piece the tables of its contexts here, and for words dealt out those of all contexts here; its own
        sums. first: the tokens; keys and customers go along."""
        at_tables = np.bincount(self.context_of, weights=tables, minlength=len(self.contexts)).astype(np.int64)
        customers = np.bincount(self.context_of, weights=self.learnt, minlength=len(self.contexts)).astype(np.int64)
        own, learnt, split = self.parent(tables), np.bincount(self.word_of, weights=self.learnt, minlength=len(self.words)).astype(np.int64), self.split(deal)
        bounds = deal.piece_bounds(self.contexts)
        to = (self.words[split] % np.uint64(deal.shares)).astype(np.int64)
        for p in np.union1d(np.flatnonzero(np.diff(bounds)), to):
            a, b = bounds[p], bounds[p + 1]
            words = split[to == p]
            data = {"tables": _small(at_tables[a:b]), "own": own[words]}
            if first is not None:
                data |= {"contexts": _steps(self.contexts[a:b]), "n": int(b - a), "customers": _small(customers[a:b]), "words": self.words[words], "learnt": learnt[words]}
            yield self.number, int(p), data
        cold = np.ones(len(self.words), bool)
        cold[split] = False
        n = own[cold]
        sums = {"n1": (self.learnt == 1).sum(), "n2": (self.learnt == 2).sum(), "words": (learnt[cold] > 0).sum(), "parent_customers": n.sum(), "w1": (n == 1).sum(), "w2": (n == 2).sum(), "parent_tables": parent_tables[cold].sum()} | (first or {})
        yield self.number, -1 - self.number % 16, {k: float(v) for k, v in sums.items()}

    def answers(self, deal: Deal, rows: pa.Table) -> dict[str, np.ndarray]:
        """What the pieces sent, in the order of its contexts and of its words that are dealt out."""
        found = {p: _unpacked(x.as_py()) for p, x in zip(rows.column("piece").to_pylist(), rows.column("payload"))}
        out = {k: np.concatenate([found[p][k] for p in sorted(found)]).astype(np.int64) for k in next(iter(found.values())) if k in ("tables", "customers")}
        split = self.split(deal)
        to = (self.words[split] % np.uint64(deal.shares)).astype(np.int64)
        for k in ("own", "parent_tables", "learnt"):
            if all(k in x for x in found.values()):
                out[k] = np.zeros(len(split), np.int64)
                for p in np.unique(to):
                    out[k][to == p] = found[int(p)][k]
        return out


def _gather(rows: pa.Table, folder: str, deal: Deal) -> pa.Table:
    """All that was dealt to one share: counts by type, and where each document's tokens are among them, as files."""
    number = rows.column("share")[0].as_py()
    blobs, docs = [], []
    for chunk, payload, doc in zip(rows.column("chunk").to_pylist(), rows.column("payload"), rows.column("docs")):
        if payload.is_valid:
            blobs.append((chunk, _unpacked(payload.as_py())))
        else:
            docs.append((chunk, _unpacked(doc.as_py())))
    tokens = sum(int(d["n"][~d["held_out"]].sum()) for _, d in docs)
    if not blobs:
        _store(folder, f"docs-{number}", {"docs": docs})
        return _rows([(number, -1 - number % 16, {"tokens": float(tokens)})])
    words = np.concatenate([np.repeat(b["words"], b["n"]) for _, b in blobs])
    contexts = np.concatenate([_whole(b["contexts"]) for _, b in blobs])
    order = np.lexsort((contexts, words))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (contexts[order][1:] != contexts[order][:-1])
    of_type = np.empty(len(words), np.int64)
    of_type[order] = np.cumsum(new) - 1
    firsts = order[new]
    learnt = np.bincount(of_type, weights=np.concatenate([b["learnt"] for _, b in blobs])).astype(np.int64)
    own, n = np.unique(words[firsts], return_counts=True)
    keys, context_of = np.unique(contexts[firsts], return_inverse=True)
    data = {"words": own, "n": _small(n), "contexts": _steps(keys), "n_contexts": len(keys), "context_of": _small(context_of), "learnt": _small(learnt)}
    _store(folder, f"types-{number}", data)
    places, at = [], 0
    for chunk, b in blobs:
        m = len(b["learnt"])
        places.append((chunk, (int(of_type[at]), _small(np.diff(of_type[at : at + m]))), b["seen"], b["docs"]))
        at += m
    _store(folder, f"docs-{number}", {"docs": docs, "places": places})
    share = Share(folder, number, data)
    tables = (share.learnt > 0).astype(np.int64)
    parent_tables = (share.parent(tables) > 0).astype(np.int64)
    _store(folder, f"seats-{number}-0", (_small(tables), _small(parent_tables)))
    return _rows(list(share.messages(deal, tables, parent_tables, {"tokens": tokens})))


def _add(rows: pa.Table, folder: str, deal: Deal, model: Model | None, s: int, seating: Seating) -> pa.Table:
    """One piece, after sweep s: the sums of its keys, for each share those that it holds. Words dealt out are seated in
    the parent restaurant. Without a model (before the first sweep) the shares' keys are kept in a file."""
    piece = rows.column("piece")[0].as_py()
    if piece < 0:
        return _total(rows)
    messages = sorted(((n, _unpacked(x.as_py())) for n, x in zip(rows.column("share").to_pylist(), rows.column("payload"))), key=lambda m: m[0])
    if model is None:
        lists = [_from_steps(m["contexts"], m["n"]) for _, m in messages]
        keys, at = np.unique(np.concatenate(lists), return_inverse=True)
        words, word_at = np.unique(np.concatenate([m["words"] for _, m in messages]), return_inverse=True)
        _store(folder, f"keys-{piece}", {"n": len(keys), "at": _small(at), "words": words, "word_at": _small(word_at)})
    else:
        kept = _load(folder, f"keys-{piece}")
        keys, at, words, word_at = range(kept["n"]), kept["at"].astype(np.int64), kept["words"], kept["word_at"].astype(np.int64)
    added = lambda name, where, n: np.bincount(where, weights=np.concatenate([m[name] for _, m in messages]), minlength=n).astype(np.int64)
    sums = {"tables": added("tables", at, len(keys))}
    theirs = {"own": added("own", word_at, len(words))}
    if model is None:
        sums["customers"] = added("customers", at, len(keys))
        theirs["learnt"] = added("learnt", word_at, len(words))
        theirs["parent_tables"] = (theirs["own"] > 0).astype(np.int64)
    else:
        theirs["parent_tables"] = np.array([seating(theirs["own"][k : k + 1], np.full(1, model.base(s - 1)), model.parent_discount, np.random.default_rng([int(w) & 0xFFFFFFFF, int(w) >> 32, s]))[0] for k, w in enumerate(words)], dtype=np.int64)
    own = theirs["own"]
    out = [(-1, piece, {"words": float((own > 0).sum()), "parent_customers": float(own.sum()), "w1": float((own == 1).sum()), "w2": float((own == 2).sum()), "parent_tables": float(theirs["parent_tables"].sum())})]
    begin = word_begin = 0
    for number, m in messages:
        mine, my_words = at[begin : begin + len(m["tables"])], word_at[word_begin : word_begin + len(m["own"])]
        out.append((number, piece, {k: _small(x[mine]) for k, x in sums.items()} | {k: x[my_words] for k, x in theirs.items()}))
        begin, word_begin = begin + len(mine), word_begin + len(my_words)
    return _rows(out)


def _total(rows: pa.Table) -> pa.Table:
    sums: Counter = Counter()
    for x in rows.column("payload"):
        sums.update(_unpacked(x.as_py()))
    return _rows([(-1, -1, dict(sums))])


def _share(folder: str, number: int) -> Share:
    return Share(folder, number, _load(folder, f"types-{number}"))


def _known(share: Share, deal: Deal, s: int, rows: pa.Table) -> dict[str, np.ndarray]:
    """What the share needs after sweep s: answers of the pieces, besides seats. Kept in a file for later."""
    found = share.answers(deal, rows)
    _store(share.folder, f"sums-{share.number}-{s}", {k: _small(x) for k, x in found.items()})
    return found


def _above(share: Share, deal: Deal, model: Model, s: int, tables: np.ndarray, parent_tables: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
    split = share.split(deal)
    customers, at = share.parent(tables), parent_tables.copy()
    customers[split], at[split] = found["own"], found["parent_tables"]
    return model.above(s, customers, at)


def _sweep(rows: pa.Table, folder: str, deal: Deal, model: Model, s: int, seating: Seating) -> pa.Table:
    """Sweep s of one share, from the sums after the sweep before."""
    share = _share(folder, rows.column("share")[0].as_py())
    found = _known(share, deal, s - 1, rows)
    tables, parent_tables = (x.astype(np.int64) for x in _load(folder, f"seats-{share.number}-{s - 1}"))
    above = _above(share, deal, model, s - 1, tables, parent_tables, found)
    rng = np.random.default_rng([share.number, s])
    weight = (STRENGTH + model.discount * found["tables"][share.context_of]) * above[share.word_of]
    tables = seating(share.learnt, weight, model.discount, rng)
    parent_tables = seating(share.parent(tables), np.full(len(share.words), model.base(s - 1)), model.parent_discount, rng)
    _store(folder, f"seats-{share.number}-{s}", (_small(tables), _small(parent_tables)))
    return _rows(list(share.messages(deal, tables, parent_tables)))


_SCORED = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("score", pa.binary())])


def _scores(rows: pa.Table, folder: str, deal: Deal, model: Model, burn_in: int) -> pa.Table:
    """A share's log probabilities, averaged over sweeps, added up for the documents of each chunk."""
    share = _share(folder, rows.column("share")[0].as_py())
    last = len(model.after) - 1
    _known(share, deal, last, rows)
    first = _load(folder, f"sums-{share.number}-0")
    customers = first["customers"].astype(np.int64)[share.context_of]
    mean, counted = np.zeros(len(share.learnt)), [s for s in range(last + 1) if s > burn_in or s == last]
    for s in counted:
        found = {k: x.astype(np.int64) for k, x in _load(folder, f"sums-{share.number}-{s}").items()}
        tables, parent_tables = (x.astype(np.int64) for x in _load(folder, f"seats-{share.number}-{s}"))
        above = _above(share, deal, model, s, tables, parent_tables, found)[share.word_of]
        mean += model.within(share.learnt, tables, customers, found["tables"][share.context_of], above)
    log_p = np.log10(mean / len(counted))
    counts = np.bincount(share.word_of, weights=share.learnt, minlength=len(share.words))
    counts[share.split(deal)] = first["learnt"]
    base = np.log10((counts + 0.1) / (model.after[0]["tokens"] + 0.1 * (model.vocabulary + 1)))[share.word_of]
    known = (counts > 0)[share.word_of].astype(float)
    out = []
    for chunk, types, seen, docs in _load(folder, f"docs-{share.number}")["places"]:
        at, docs = np.repeat(_from_steps(types, len(seen)).astype(np.int64), seen), docs.astype(np.int64)
        size = int(docs.max()) + 1
        sums = [np.bincount(docs, weights=x[at], minlength=size) for x in (log_p, base, known)]
        has = np.flatnonzero(np.bincount(docs, minlength=size))
        out.append({"chunk": chunk, "docs": None, "score": _packed((_small(has), sums[0][has], sums[1][has], _small(sums[2][has].astype(np.int64))))})
    return pa.Table.from_pylist(out, schema=_SCORED)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(rows: pa.Table, tokens: int) -> pa.Table:
    docs = next(_unpacked(d.as_py()) for d in rows.column("docs") if d.is_valid)
    score, base, known = (np.zeros(len(docs["ids"])) for _ in range(3))
    for s in sorted(s.as_py() for s in rows.column("score") if s.is_valid):
        at, a, b, k = _unpacked(s)
        score[at] += a
        base[at] += b
        known[at] += k
    ids = docs["ids"]
    return pa.table([pa.array(ids, mask=ids == NULL_ID), pa.array(docs["held_out"]), pa.array(docs["n"]), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base), pa.array(score)], schema=_SCORES)


def _common(docs: DataFrame, n: int) -> tuple[float, DataFrame]:
    """Tokens of all documents, about, and (word, part) of a sample: which part of its tokens each word makes up."""
    part = min(1.0, max(SAMPLE / max(1, n), SAMPLE_PART))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000)).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(word_hashes(words_of(text.as_py())).view(np.int64).tolist())
                found[int(END.view(np.int64))] += 1
        words, counts = [*found, None], [*found.values(), sum(found.values())]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(counts, pa.int64())], names=["word", "n"])

    counted = written(sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    seen = (counted.where("word is null").first() or [None, 0])[1]
    return seen / part, counted.where("word is not null").select("word", (F.col("n") / max(1, seen)).alias("part"))


def score(documents: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN, share_tokens: int = SHARE_TOKENS, bits: int | None = None, seating: Seating = seat) -> DataFrame:
    """`documents` (doc_id, text): rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row."""
    spark = documents.sparkSession
    importable(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = docs.count()
    if not n:
        return spark.createDataFrame([], SCORES)
    tokens, parts = _common(docs, n)
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / share_tokens))
    # fewer than 2 * shares words
    split = np.sort(np.array([r.word for r in parts.where(F.col("part") >= 0.5 / shares).select("word").collect()], dtype=np.int64).view(np.uint64))
    deal = Deal(split, shares, min(64, bits or math.ceil(math.log2(max(2, tokens))) + CONTEXT_BITS))
    folder = fresh_folder(spark, "restaurants")
    dealt = docs.mapInArrow(lambda b: _deal(b, deal), "share int, chunk long, payload binary, docs binary")
    told = dealt.groupBy("share").applyInArrow(lambda t: _gather(t, folder, deal), EXCHANGED)

    def run(step: Callable, model: Model | None, s: int) -> Callable[[pa.Table], pa.Table]:
        return lambda t: step(t, folder, deal, model, s, seating)

    model = None
    for s in range(sweeps + 1):
        if model is not None:
            told = answers.groupBy("share").applyInArrow(run(_sweep, model, s), EXCHANGED)
        added = written(told.groupBy("piece").applyInArrow(run(_add, model, s), EXCHANGED), "sums")
        answers = added.where("share >= 0")
        sums: Counter = Counter(dict.fromkeys(SUMS, 0.0))
        few = added.where("share < 0").withColumn("part", F.pmod("piece", F.lit(16))).groupBy("part").applyInArrow(_total, EXCHANGED)
        for r in few.collect():  # 16 rows at most
            sums.update(_unpacked(bytes(r.payload)))
        model = Model.begin(dict(sums)) if model is None else model.and_then(dict(sums))
    scored = answers.groupBy("share").applyInArrow(lambda t: _scores(t, folder, deal, model, burn_in), "chunk long, docs binary, score binary")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for number in batch.column("share").to_pylist():
                if store.get_file_info(f"{root}/docs-{number}").type != fs.FileType.NotFound:
                    for chunk, d in _load(folder, f"docs-{number}")["docs"]:
                        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "docs": _packed(d), "score": None}], schema=_SCORED)

    rows = spark.range(shares).select(F.col("id").cast("int").alias("share")).repartition(shares).mapInArrow(names, "chunk long, docs binary, score binary")
    train = int(model.after[0]["tokens"])
    return scored.union(rows).groupBy("chunk").applyInArrow(lambda t: _finish(t, train), SCORES)
