"""Hashed word shingles of whole texts, many texts at a time, in numpy.

A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, so no
word is ever cut out as a Python object. Each byte stands for a fixed random number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes hashed at a time; a block ends between words.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number through a fixed permutation in which every bit matters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tuple(tables)
    return _powers


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a block that cuts no word."""
    blank = _BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the text of each."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    first = np.cumsum(lengths) - lengths
    starts, hashes, at = [], [], 0
    while at < len(data):
        size = BLOCK
        end = min(at + size, len(data))
        while end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
                break
            size *= 2
            end = min(at + size, len(data))
        s, h = _block_words(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.searchsorted(first, np.concatenate(starts), "right") - 1


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of ``size`` words.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    one = np.uint64(_BASE)
    rolling = words.copy()
    for j in range(1, size):
        head = max(len(words) - j, 0)
        rolling[:head] = mixed(rolling[:head] * one + words[j:])
    for start, end in zip(bounds[:-1], bounds[1:]):
        count = int(end - start)
        if count >= size:
            yield np.unique(rolling[start: end - size + 1])
        elif count:
            value = words[start: start + 1]
            for j in range(1, count):
                value = mixed(value * one + words[start + j: start + j + 1])
            yield mixed(value + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
