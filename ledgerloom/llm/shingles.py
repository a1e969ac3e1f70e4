"""Words, shingles and MinHash signatures of texts, as numbers."""

from __future__ import annotations

import numpy as np
import xxhash

from ledgerloom.llm.common import keeps

#: Words whose hash a worker keeps.
KEPT_WORDS = 400_000
_hashes: dict[bytes, int] = {}
keeps("word hashes", _hashes.clear)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; bytes split and fold in just this way."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    found = list(map(_hashes.get, words))
    if None in found:
        if len(_hashes) > KEPT_WORDS:
            _hashes.clear()
        for k, x in enumerate(found):
            if x is None:
                w = words[k]
                found[k] = x = xxhash.xxh64_intdigest(w)
                if len(w) <= 48:
                    _hashes[w] = x
    return np.array(found, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words; none if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for j in range(n):
        out = mixed(out * _A + hashes[j : len(hashes) - n + 1 + j])
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingles of n words; of fewer words the whole sequence as one; without words none."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(n, len(hashes))))


def permutations(k: int) -> np.ndarray:
    return (np.random.default_rng(7).integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least high half of shingle * factor, for each factor."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[k : k + 2048, None] * factors[None, :]).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)
