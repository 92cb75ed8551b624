"""Words and hashed word shingles, for whole texts.

Words are runs of bytes other than the six ASCII spaces, A to Z lower-cased. A
shingle is five words in a row, under a 64-bit hash; a text of one to four words
has one shingle, the whole of it.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
CACHE_WORDS = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * j + 3) ** 7 % 2**64 | 1) for j in range(WORDS)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hash = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread hashes evenly over 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_sequence(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words, up to WORDS, from the words' hashes."""
    # a short text's one shingle must differ from any longer text's shingles
    out = np.full(max(0, len(h) - k + 1), np.uint64(0 if k == WORDS else k), dtype=np.uint64)
    for j in range(k):
        out += h[j : j + len(out)] * _FACTORS[j]
    return mix(out)


def shingle_sequence(h: np.ndarray) -> np.ndarray:
    """The hash of each shingle, in the order of the text, from its words' hashes."""
    return gram_sequence(h, min(len(h), WORDS)) if len(h) else h


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, as sorted unsigned hashes."""
    return np.unique(shingle_sequence(word_hashes(words_of(text))))
