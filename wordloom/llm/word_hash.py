"""Hashes of words and of word spans, in vectors; the same for a span wherever it stands."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .tokens import split_words

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(steps)
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Words of a batch of texts and span hashes over them: the sum of word hashes times powers of an odd base,
    modulo 2**64, made independent of the place by the inverse power."""

    def __init__(self, texts: pa.Array, normal: Callable[[pa.Array], pa.Array] | None = None):
        """normal maps distinct words to what is hashed; words that it maps to an empty string are left out."""
        self.first, self.words = split_words(texts)
        coded = self.words.dictionary_encode()
        if normal is not None:
            mapped = normal(coded.dictionary)
            full = pc.not_equal(pc.binary_length(mapped), 0).to_numpy(zero_copy_only=False)
            which = coded.indices.to_numpy()
            kept = full[which]
            self.first = np.concatenate(([0], np.cumsum(kept)))[self.first]
            self.words = self.words.filter(pa.array(kept))
            coded = pa.DictionaryArray.from_arrays(pa.array(which[kept]), mapped)
        distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        self.hashes = distinct[coded.indices.to_numpy()]
        n = len(self.hashes)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(BASE, n), dtype=np.uint64)))
        self._back = _powers(INVERSE, n + 1)

    def span(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self._sums[start + length] - self._sums[start]) * self._back[start])

    def every(self, length: int) -> np.ndarray:
        """Hashes of the spans of so many words from each word on, across texts."""
        n = len(self.hashes) - length + 1
        return mix((self._sums[length:] - self._sums[:-length]) * self._back[:n]) if n > 0 else np.empty(0, np.uint64)

    def starts(self, length: int) -> np.ndarray:
        """First words of all spans of so many words that lie in one text, in order."""
        from .tokens import ragged

        return ragged(self.first[:-1], np.maximum(0, np.diff(self.first) - length + 1)).astype(np.int64)

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1
