"""Operator 4: token ids as flat binary files that readers map into memory.

A data set is a folder of parts, in ascending doc_id order from part to part and within each part:

* `part-NNNNN-TRY.tokens`: all ids of the part's documents, one after another, little-endian unsigned integers of
  `width` bytes (2 where the vocabulary fits, else 4);
* `part-NNNNN-TRY.offsets`: 64-bit integers, where each document begins in the part, and at last the part's length;
* `part-NNNNN-TRY.docs`: the 64-bit doc_id of each document (NULL_ID for null);
* `manifest.json`: width, and for each part its files, numbers of documents and tokens, and its base: how many
  tokens the parts before it hold, a prefix sum over the parts. A document's global offset is base + offset.

Empty and null texts give a document with the end id alone; repeated rows are written as often as they come; equal
doc_ids are ordered by text; an empty table gives a manifest without parts. Other columns are ignored.

Each try of a task writes files of its own, and the manifest, which is written last, names those of the try whose row
came back; so nothing is renamed or replaced, and what a lost executor left is never read. The driver sees one row for
each part. Readers map files of local stores into memory; of other stores they read the ranges they need.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable
from ledgerloom.llm.word_bpe import encoder

NULL_ID = -(1 << 63)
#: Tokens that a writer holds before they go to the file, and that a reader checks at once.
BUFFERED = 1 << 20

PART = "part int, tokens string, offsets string, docs string, first_id long, n_docs long, n_tokens long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer)
    end = np.array([end_id], dtype=coder.kind).tobytes()
    store, root = fs.FileSystem.from_uri(folder)
    part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
    name = f"part-{part:05d}-{attempt}"
    files = {}
    buffer, held, at, offsets, ids, n, first = [], 0, 0, [0], [], 0, None
    for batch in batches:
        if not files and batch.num_rows:
            files = {kind: store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("tokens", "offsets", "docs")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = coder.encode(text.as_py())
            buffer += raw, end
            held += len(raw)
            at += len(raw) // coder.width + 1
            offsets.append(at)
            ids.append(NULL_ID if doc is None else doc)
            first = ids[0] if first is None else first
            n += 1
            if held > BUFFERED * coder.width:
                files["tokens"].write(b"".join(buffer))
                buffer, held = [], 0
            if len(offsets) > BUFFERED:
                files["offsets"].write(np.array(offsets, "<i8").tobytes())
                files["docs"].write(np.array(ids, "<i8").tobytes())
                offsets, ids = [], []
    if not files:
        return
    files["tokens"].write(b"".join(buffer))
    files["offsets"].write(np.array(offsets, "<i8").tobytes())
    files["docs"].write(np.array(ids, "<i8").tobytes())
    for stream in files.values():
        stream.close()
    yield pa.RecordBatch.from_pylist([{"part": part, **{k: f"{name}.{k}" for k in files}, "first_id": first, "n_docs": n, "n_tokens": at}], schema=pa.schema([("part", pa.int32()), ("tokens", pa.string()), ("offsets", pa.string()), ("docs", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end_id: int, ordered: bool = True, partitions: int | None = None) -> dict:
    """Encode `documents` (doc_id, text), each with `end_id` after it, into files in `folder`; returns the manifest.

    `folder` is a URI that executors share. Without `ordered`, parts are as the input is read, and no text is
    shuffled. The driver gets one row for each part, whatever the parts hold.
    """
    spark = documents.sparkSession
    importable(spark)
    wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if ordered:
        wanted = (wanted.repartitionByRange(partitions, "doc_id") if partitions else wanted.repartitionByRange("doc_id")).sortWithinPartitions("doc_id", "text")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    rows = wanted.mapInArrow(lambda batches: _write(batches, folder, tokenizer, end_id), PART).collect()
    parts, base = [], 0
    for row in sorted(rows, key=lambda r: r.part):
        parts.append(row.asDict() | {"base": base})
        base += row.n_tokens
    manifest = {"width": encoder(tokenizer).width, "end_id": end_id, "n_docs": sum(p["n_docs"] for p in parts), "n_tokens": base, "parts": parts}
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Ranges:
    """A file of numbers in a store that can't be mapped: slices are read when they are asked for, BUFFERED numbers at least."""

    def __init__(self, store: fs.FileSystem, path: str, kind: str) -> None:
        self.file, self.kind = store.open_input_file(path), np.dtype(kind)
        self.size, self.begin, self.held = self.file.size() // self.kind.itemsize, 0, np.empty(0, kind)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> np.ndarray:
        if not isinstance(at, slice):
            return self[int(at) : int(at) + 1][0]
        a, b, _ = at.indices(self.size)
        if a < self.begin or b > self.begin + len(self.held):
            n = max(b - a, BUFFERED)
            self.begin, self.held = a, np.frombuffer(self.file.read_at(min(n, self.size - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)
        return self.held[a - self.begin : b - self.begin]


def _mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray | Ranges:
    """The file as an array, mapped where the store is local."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if store.get_file_info(path).size else np.empty(0, kind)
    return Ranges(store, path, kind)


class TokenPart:
    """One part of a data set, open for reading: `len(part)`, `part[k]` the ids of document k, `part.start(k)`."""

    def __init__(self, folder: str, row: dict, width: int) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        self.base = row["base"]
        self.tokens = _mapped(store, f"{root}/{row['tokens']}", f"<u{width}")
        self.offsets = _mapped(store, f"{root}/{row['offsets']}", "<i8")
        self.docs = _mapped(store, f"{root}/{row['docs']}", "<i8")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.tokens[self.offsets[k] : self.offsets[k + 1]]

    def start(self, k: int) -> int:
        return self.base + int(self.offsets[k])


def read_manifest(folder: str) -> dict:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def crc_of(ids: np.ndarray) -> int:
    """The unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    crc = 0
    for k in range(0, len(ids), BUFFERED):
        crc = zlib.crc32(ids[k : k + BUFFERED].astype("<u4").tobytes(), crc)
    return crc


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Read a data set back: a row (doc_id, start, n_tokens, ids_crc32) for each document in its files."""
    importable(spark)
    manifest = read_manifest(folder)
    width = manifest["width"]
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(folder, row, width)
                for k in range(0, len(part), 10_000):
                    some = range(k, min(k + 10_000, len(part)))
                    yield pa.RecordBatch.from_pylist([{"doc_id": None if (doc := int(part.docs[i])) == NULL_ID else doc, "start": part.start(i), "n_tokens": int(part.offsets[i + 1] - part.offsets[i]), "ids_crc32": crc_of(part[i])} for i in some], schema=fields)

    parts = spark.createDataFrame([(p["tokens"], p["offsets"], p["docs"], p["base"]) for p in manifest["parts"]], "tokens string, offsets string, docs string, base long")
    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
