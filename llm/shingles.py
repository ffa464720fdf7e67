"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from llm.batches import Cache
from llm.syncmers import scrambled

WORDS = 5
_WORD = re.compile(r"\w+")
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(64)]


class Shingler:
    """Sorted distinct hashes of the runs of ``words`` words (letters, digits and underscores, in small letters). A
    shorter text has one shingle, of all its words; a text without words has none."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, Cache()

    def __call__(self, text: str) -> np.ndarray:
        words, known = _WORD.findall(text.lower()), self.known
        for word in [word for word in set(words) if word not in known]:
            known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(hashes):
            return hashes
        size = min(self.words, len(hashes))
        runs = sum((hashes[i : len(hashes) - size + 1 + i] * _POWERS[i] for i in range(size)), np.uint64(size))
        return np.unique(scrambled(runs))
