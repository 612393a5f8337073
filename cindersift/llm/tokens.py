"""Hashes of words and of runs of words as numpy arrays, for use inside tasks."""

from __future__ import annotations

import re
import warnings

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(29)


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met lately: at most ``most`` of them."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Another hash of each value, for each seed."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        v = (values ^ (np.uint64(seed) * ODD)) * MIX
        return (v ^ (v >> SHIFT)) * ODD


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in order; of the whole text if it is shorter; none without words."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * MIX + hashes[k : n + k]
    return mixed(out)
