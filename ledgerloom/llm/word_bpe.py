"""Word-wise encoding with a tokenizer of the `tokenizers` library, as operators 4 and 9 need it.

The tokenizers meant here split at white space and drop it, so a text's ids are those of its words in turn. Most
words of a corpus repeat: each worker keeps the ids of the words it has met, and the library sees a word only once.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

from ledgerloom.llm.common import keeps, slices

#: A character that no ordinary word holds; it stands between words handed to the library together.
MARK = "\x01"
#: Words kept per worker (about 100 bytes each), and the longest kept.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 48
#: Words handed to the library at once; it slows down on much longer texts.
TOGETHER = 100
#: Letters up to U+024F, where composition changes nothing and lower case goes letter by letter, then marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?;:%&$#*]*)")
#: The steps before merging for which a plain word's letters and marks are encoded apart.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: How byte-level models write a byte: printable ones as themselves, the others in order from U+0100.
_BYTES = {b: b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN) for b in range(256)}


class WordEncoder:
    """`encode(text)`: the ids of the whole text as little-endian unsigned integers of `width` bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        steps = json.loads(self.library.to_str())
        self.plain = all(steps[k] == v for k, v in _STEPS.items())
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = self.ids(MARK)
        # joining words is exact only if white space separates and the mark is one token of its own
        self.apart = len(self.mark) == self.width and self.ids(f"a {MARK} b") == self.ids("a") + self.mark + self.ids("b") and self.ids("a b") == self.ids("a") + self.ids("b")

    def ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def part(self, letters: str) -> bytes:
        """The ids of letters, or of marks, alone, by the library's merging step."""
        found = self.parts.get(letters)
        if found is None:
            if len(self.parts) > KEPT_WORDS // 2:
                self.parts.clear()
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES)
            found = self.parts[letters] = np.array([t.id for t in self.library.model.tokenize(shown)], dtype=self.kind).tobytes()
        return found

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, many at a time."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if self.plain:
            rest = []
            for w in words:
                if m := _PLAIN.fullmatch(w):
                    letters, marks = m.groups()
                    self.known[w] = self.part(letters.lower()) + self.part(marks) if marks else self.part(letters.lower())
                else:
                    rest.append(w)
            words = rest
        alone = [w for w in words if MARK in w or len(w) > KEPT_LENGTH or any(s in w for s in self.special)]
        self.known |= {w: self.ids(w) for w in alone}
        words = list(set(words).difference(alone))
        mark = int(np.frombuffer(self.mark, self.kind)[0])
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            found = np.array(self.library.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends = [0, *(np.flatnonzero(found == mark) * self.width).tolist(), len(found) * self.width]
            raw = found.tobytes()
            self.known |= {w: raw[a + self.width * (i > 0) : b] for i, (w, a, b) in enumerate(zip(some, ends, ends[1:]))}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.apart:
            return self.ids(text)
        out = []
        for part in slices(text):
            words = part.replace("\n", " ").split(" ")  # other white space stays inside words, where the library drops it
            found = list(map(self.known.get, words))
            if None in found:
                self.learn([w for w, x in zip(words, found) if x is None])
                # learning may have dropped the words known before: those keep the ids found
                found = [self.known[w] if x is None else x for w, x in zip(words, found)]
                for w in words:
                    if len(w) > KEPT_LENGTH:
                        self.known.pop(w, None)
            out.append(b"".join(found))
        return b"".join(out)


@cache
def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


keeps("words", encoder.cache_clear)
