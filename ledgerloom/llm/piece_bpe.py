"""Operator 1: SentencePiece encoding and decoding, for models of merge type, exactly as the library does it.

Merging picks the best-scored pair again and again, the leftmost of equals. Its result is the one sequence of pieces
in which each two neighbours are compatible: merging both pieces' characters anew gives the same two pieces. So a text
can be encoded from left to right: an Aho-Corasick automaton finds all pieces that begin at a place; the longest one
compatible with the piece before is taken; where none is, the place is marked in a bitfield of failed positions, the
last piece is taken back and the next shorter one tried. The accepted pieces are always the true encoding of what they
cover, so a failed position stays failed.

Texts are cut where no piece can reach across: before a space that follows another character, around characters that
the model has no piece for (they fall back to bytes), and at newlines if no piece holds one. Runs of spaces, whose
pieces share one score, follow the merge order itself. Words repeat, so each worker keeps the result of those it met.

Null and empty texts have no ids and decode to the empty text; texts of any length are read whole, part by part;
repeated rows and null doc_ids come back as they are; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import importable, slices

SPACE = "▁"
#: Words kept per worker, the longest kept, and pairs of pieces whose compatibility is kept.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 600_000, 48, 2_000_000
#: Start positions whose matches are looked up at once.
BLOCK = 4096
#: Characters of a text that are encoded at once.
PART = 1 << 19

#: Texts that a normaliser would change: white space at the ends and in runs, full width, composed and decomposed, old digits.
PROBES = ("a  b", " a", "a ", "\ta\n", "\uff21\uff42\uff11", "e\u0301 \u00e9", "\u2460\ufb01", "A\u00adB", "\u3000x", "<s>", "</s>", "<unk>", "<0x41>")

_WORDS = re.compile(r" +[^ \n]*|\n[^ \n]*")
_SPACED = re.compile(r" +[^ ]*")


class PieceModel:
    """A merge-type model: `encode(text)` and `decode(ids)`."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(k) for k in range(size)]
        self.bytes = {int(self.pieces[k][1:-1], 16): k for k in range(size) if library.is_byte(k)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.unknown = library.unk_id()
        self.hidden = {k for k in range(size) if library.is_control(k)}
        plain = [k for k in range(size) if k != self.unknown and k not in self.hidden and k not in self.byte_of and not library.is_unused(k)]
        self.id = {self.pieces[k]: k for k in plain}
        self.rank = {p: -library.get_score(k) for p, k in self.id.items()}
        self.characters = {p for p in self.id if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        self.size = size
        # pieces that merging never makes take no part
        self.length = {k: len(self.pieces[k]) for k in plain}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.id.items():
            if set(p) <= self.characters and (len(p) == 1 or p.strip(SPACE) and self.merge(p) == [p]):
                self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.id), default=1)
        self.unmatched = re.compile("[^" + re.escape("".join(sorted(self.characters))) + "]+") if self.characters else re.compile("(?s).+")
        self.lines_apart = not any("\n" in p for p in self.id)
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.id):
            raise ValueError("a piece of this model holds a space inside; words can't be encoded apart")
        self.known: dict[str, tuple[str, str]] = {}
        # models that change texts first, or have symbols of their own that merging doesn't make, are not for this operator
        kept = {k for _, (_, k) in self.automaton.items()}
        for text in (*PROBES, *(p.replace(SPACE, " ") for p, k in self.id.items() if k not in kept and p.strip(SPACE))):
            if self.encode(text) != library.encode(text):
                raise ValueError(f"this model doesn't encode {text!r} by merging alone")

    # merging, plainly: for pairs of pieces and runs of spaces

    def merge(self, text: str) -> list[str]:
        """The pieces of `text` by merging the best pair, leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.size + right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(a + b) == [a, b]
        return found

    # encoding

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text whose characters are all pieces, without runs of spaces."""
        n, length, compatible = len(text), self.length, self.compatible
        failed = bytearray(n // 8 + 1)
        blocks: dict[int, list[list[int]]] = {}

        def matches(at: int) -> list[int]:
            k = at // BLOCK
            if k not in blocks:
                if len(blocks) > 8:
                    del blocks[max(blocks, key=lambda b: abs(b - k))]
                begin, end = k * BLOCK, min(n, (k + 1) * BLOCK)
                rows: list[list[int]] = [[] for _ in range(end - begin)]
                for last, (size, piece) in self.automaton.iter(text[begin : min(n, end + self.longest)]):
                    if (first := last - size + 1) < len(rows):
                        rows[first].append(piece)
                blocks[k] = rows
            return blocks[k][at - k * BLOCK]

        out: list[int] = []
        tried: list[int] = []
        at = 0
        here = matches(0)
        k = len(here) - 1
        while True:
            last = out[-1] if out else -1
            while k >= 0:
                piece = here[k]
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or compatible(last, piece)):
                    break
                k -= 1
            if k >= 0:
                out.append(piece)
                tried.append(k)
                at = end
                if at == n:
                    return out
                here = matches(at)
                k = len(here) - 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= length[out.pop()]
                here = matches(at)
                k = tried.pop() - 1

    @cache  # noqa: B019  one model lives as long as its worker
    def spaces(self, n: int) -> tuple[int, ...]:
        """The ids of n spaces in a row. Beyond the longest such piece, that piece is made first and then the rest."""
        most = max(len(p) for p in self.id if not p.strip(SPACE))
        if n > 3 * most:
            k = (n - 2 * most) // most
            return (self.id[SPACE * most],) * k + self.spaces(n - k * most)
        return tuple(self.id[p] for p in self.merge(SPACE * n))

    def fallback(self, text: str) -> list[int]:
        if len(self.bytes) < 256:
            return [self.unknown]
        return [self.bytes[b] for b in text.encode()]

    def encode_word(self, word: str) -> list[int]:
        """The ids of a piece of text in which spaces, as `▁`, stand at the beginning alone."""
        rest = word.lstrip(SPACE)
        runs = len(word) - len(rest)
        if runs > 1:
            ids = self.encode_word(SPACE + rest) if rest else [self.id[SPACE]]
            alone = ids[0] == self.id[SPACE]
            return [*self.spaces(runs if alone else runs - 1), *ids[alone:]]
        out, at = [], 0
        for m in self.unmatched.finditer(word):
            if m.start() > at:
                out += self.backtrack(word[at : m.start()])
            out += self.fallback(m[0])
            at = m.end()
        if at < len(word):
            out += self.backtrack(word[at:])
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text that begins with a space or a newline, each with what stands before it but for one space."""
        if self.lines_apart:
            spaced = text.replace("\n", " \n") if "\n" in text else text
            if "  " not in spaced and spaced[0] == " ":
                return spaced[1:].split(" ")
            return [m[1:] if m[0] == " " else m for m in _WORDS.findall(text)]
        return [m[1:] for m in _SPACED.findall(text)]

    def looked_up(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """Part after part of a text: for each word its ids, joined by commas, and what they decode to."""
        for part in slices(" " + text.replace(SPACE, " ") if text else "", PART):
            if not part:
                continue
            words = self.words(part)
            found = list(map(self.known.get, words))
            if None in found:
                if len(self.known) > KEPT_WORDS:
                    self.known.clear()
                for k, (word, x) in enumerate(zip(words, found)):
                    if x is None and (x := self.known.get(word)) is None:
                        ids = self.encode_word(word if self.lines_apart and word[:1] == "\n" else SPACE + word.replace(" ", SPACE))
                        x = ",".join(map(str, ids)), self.shown(ids)
                        if len(word) <= KEPT_LENGTH:
                            self.known[word] = x
                    found[k] = x
            yield found

    def encode(self, text: str | None) -> list[int]:
        return [int(k) for found in self.looked_up(text or "") for ids, _ in found for k in ids.split(",")]

    # decoding

    def shown(self, ids: list[int]) -> str:
        """What ids stand for inside a text, the space at its very beginning included."""
        out, pending = [], bytearray()
        for k in ids:
            if (b := self.byte_of.get(k)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_utf8(pending))
                pending.clear()
            if k == self.unknown:
                out.append(" ⁇ ")
            elif k not in self.hidden:
                out.append(self.pieces[k])
        if pending:
            out.append(_utf8(pending))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space put before a text's first word goes."""
        text = self.shown(ids)
        first = next((k for k in ids if k not in self.hidden), None)
        return text[1:] if first is not None and self.pieces[first][:1] == SPACE else text

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for found in self.looked_up(text or ""):
            ids = ",".join([x[0] for x in found])
            shown = "".join([x[1] for x in found])
            if n:
                ids_hash.update(b",")
            elif shown[:1] == " ":
                shown = shown[1:]
            n += ids.count(",") + 1
            ids_hash.update(ids.encode())
            text_hash.update(shown.encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that is not part of a whole character gives one U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[at : at + n]).decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@cache
def piece_model(path: str) -> PieceModel:
    """One per worker process."""
    return PieceModel(path)


def encode_column(documents: DataFrame, model: str) -> DataFrame:
    """`documents` (doc_id, text): rows (doc_id, ids array<int>, decoded string)."""
    importable(documents.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            ids = [own.encode(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())], schema=out)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(documents: DataFrame, model: str) -> DataFrame:
    """`documents` (doc_id, text): rows (doc_id, n_tokens, ids_sha256, decoded_sha256), by a scan without a shuffle."""
    importable(documents.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_model(model)
        for batch in batches:
            found = [own.digests(t.as_py()) for t in batch.column("text")]
            n, ids, text = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], schema=out)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
