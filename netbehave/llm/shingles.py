"""Sets of word shingles as 64-bit hashes.

The shingles of a text are its runs of five lower-cased words; a text with fewer words is
one shingle, the whole sequence. Words are hashed with XXH64, and a shingle's hash mixes
those of its words, so two different shingles are equal with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

from netbehave.llm.words import bounds, utf8

SIZE = 5
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator, a bijection that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in turn, and the bounds of the texts."""
    limits = bounds([len(one) for one in words])
    flat = np.empty(limits[-1], object)
    flat[:] = [word for one in words for word in one]
    number, distinct = pd.factorize(flat)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return (hashes[number] if len(distinct) else np.zeros(0, np.uint64)), limits


def shingle_hashes(hashes: np.ndarray, limits: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in turn, and the bounds of the texts."""
    lengths = np.diff(limits)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    result_limits = bounds(counts.tolist())
    owner = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(result_limits[-1]) - result_limits[:-1][owner] + limits[:-1][owner]
    left = limits[1:][owner] - place
    total = np.zeros(len(place), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            there = left > step
            word = hashes[np.where(there, place + step, 0)] if len(hashes) else total
            total = np.where(there, (total + word) * FACTOR, total * FACTOR)
        # The length tells a short text from the start of a longer shingle.
        total = mixed(total + np.minimum(left, size).astype(np.uint64))
    return total, result_limits


def shingle_sets(texts: list[str | None], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of the texts."""
    words = [utf8(text).lower().split() if text else [] for text in texts]
    values, limits = shingle_hashes(*word_hashes(words), size)
    owner = np.repeat(np.arange(len(texts)), np.diff(limits))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[fresh], minlength=len(texts))
    return values[fresh], bounds(counts.tolist())
