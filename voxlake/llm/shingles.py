"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

SHINGLE = 5
# Words whose hashes a worker remembers at most.
REMEMBERED = 200_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of a text.

    A-Z are lower-cased and words are what lies between ASCII white space. A text
    of fewer than five words is one shingle; one without words has none.
    """

    def __init__(self, words: int = SHINGLE, remembered: int = REMEMBERED) -> None:
        self.words, self.remembered = words, remembered
        self.known: dict[bytes, int] = {}

    def _word_hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > self.remembered:
                self.known.clear()
            for word in words:
                if word not in self.known:
                    self.known[word] = xxhash.xxh3_64_intdigest(word)
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: str | None) -> np.ndarray:
        words = self._word_hashes(text)
        width = min(self.words, len(words))
        if not width:
            return words
        with np.errstate(over="ignore"):
            rows = len(words) - width + 1
            out = words[:rows] + np.uint64(width)
            for k in range(1, width):
                out = _mixed(out * _STEP + words[k:k + rows])
        return np.unique(_mixed(out))


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set: equal sets have equal keys."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)
