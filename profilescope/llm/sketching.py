"""Shingle sets of whole texts and their fast similarity sketches.

A sketch has t coordinates. In round i every element of the set is hashed to a bin and to a fraction, and a bin takes
the smallest value ``i + fraction`` that it is offered; rounds go on until every bin is filled. After t such rounds
round t + b offers every element to bin b, so each coordinate is filled for any set with an element. Two
sets agree in a coordinate with the probability of their Jaccard similarity, and the share of agreeing
coordinates is concentrated about it like that of t independent ones; a sketch takes t log t + n steps instead of t n.
Dahlgaard, Knudsen and Thorup, "Fast similarity sketching", 2017.
"""

from __future__ import annotations

import numpy as np
import xxhash

from profilescope.llm.common import words_of

CACHED_WORDS = 300_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# The finaliser of splitmix64.
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S16 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(16)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _MIX_1
    x = (x ^ (x >> _S27)) * _MIX_2
    return x ^ (x >> _S31)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Distinct ``width``-word shingles of a text as sorted 64-bit hashes.

    A text with fewer words is one shingle, its whole sequence; a text without words has none. Two different
    shingles of a pair of documents share a hash with a probability of about n^2 / 2^64.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.hashes = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, dtype=np.uint64)
        found = np.fromiter(map(self.hashes.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.width, len(words))
        n = len(words) - width + 1
        total = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            total = mixed(total * _MULTIPLIER + found[i : i + n])
        return np.unique(total)


class Sketcher:
    """Fast similarity sketches with ``size`` coordinates (at most 256)."""

    def __init__(self, size: int) -> None:
        self.size = size

    def _offers(self, elements: np.ndarray, first: int, rounds: int) -> np.ndarray:
        salts = mixed((np.arange(first, first + rounds, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)
        return mixed(elements[None, :] ^ salts[:, None])

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        """The coordinates of a set with at least one element: round above a 48-bit fraction."""
        t, n = self.size, len(elements)
        filled = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
        done, step = 0, max(1, -(-6 * t // n))
        while done < t:
            rounds = min(step, t - done, max(1, (1 << 16) // n))
            hashes = self._offers(elements, done, rounds)
            numbers = np.arange(done, done + rounds, dtype=np.uint64)[:, None] << np.uint64(48)
            bins = (hashes % np.uint64(t)).ravel().astype(np.int64)
            values = (numbers | (hashes >> _S16)).ravel()
            order = np.lexsort((values, bins)) if len(bins) < 256 else np.argsort(bins, kind="stable")
            bins, values = bins[order], values[order]
            starts = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            at = bins[starts]
            filled[at] = np.minimum(filled[at], np.minimum.reduceat(values, starts))
            done += rounds
            if (filled != np.iinfo(np.uint64).max).all():
                return filled
        for b in np.flatnonzero(filled == np.iinfo(np.uint64).max):
            offers = self._offers(elements, t + int(b), 1)[0]
            filled[b] = (np.uint64(t + b) << np.uint64(48)) | (offers >> _S16).min()
        return filled

    @staticmethod
    def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
        """A 64-bit key for each band of ``rows`` coordinates; keys of different bands differ."""
        bands = sketch.reshape(-1, rows)
        key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
        for i in range(rows):
            key = mixed(key * _MULTIPLIER + bands[:, i])
        return key

    @staticmethod
    def fingerprint(sketch: np.ndarray) -> bytes:
        """One byte for each coordinate; unequal coordinates share it once in 256 times."""
        return mixed(sketch).astype(np.uint8).tobytes()
