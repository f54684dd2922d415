"""Sets of word shingles as sorted 64-bit hashes, computed over whole batches of texts.

A-Z is lower-cased, words are runs of bytes other than ASCII white space, a text's set
holds its distinct runs of five words, or its whole sequence where it has fewer. A null
or blank text has the empty set. Hashes only find shingles: :class:`ShingleSet` keeps
the words behind them, so sets are identified and compared by what they really hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import batched

import numpy as np

WIDTH = 5
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (wrapping multiplication and shifts)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _constants(count: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, count + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


_PLACES = _constants(WIDTH, 12) | np.uint64(1)
_LENGTHS = np.uint64(0xC2B2AE3D27D4EB4F)
# Longer words are hashed one by one, so that no number of steps depends on a word.
LONG_WORD = 64
SLICE_SHINGLES = 4096


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < count:
            with np.errstate(over="ignore"):
                fill = np.full(count, self.base, dtype=np.uint64)
                fill[0] = 1
                self.up = np.cumprod(fill)
                fill = np.full(count, self.inverse, dtype=np.uint64)
                fill[0] = 1
                self.down = np.cumprod(fill)
        return self.up, self.down


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word ``data[start:end]``: eight bytes at a time, each step mixed."""
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    hashes = mixed(sizes.astype(np.uint64) * _LENGTHS)
    at = np.flatnonzero(sizes <= LONG_WORD)
    step = 0
    with np.errstate(over="ignore"):
        while len(at):
            left = np.minimum(sizes[at] - step, 8)
            cells = eight[starts[at] + step] & (~np.uint64(0) >> (64 - 8 * left).astype(np.uint64))
            hashes[at] = mixed(hashes[at] * _ODD + cells)
            step += 8
            at = at[sizes[at] > step]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def _combined(words: np.ndarray, width: int) -> np.ndarray:
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(count, width, dtype=np.uint64)
        for i in range(width):
            total += words[i : i + count] * _PLACES[i]
    return mixed(total)


@dataclass
class ShingleSet:
    """Distinct shingles of a text: sorted hashes (int64) and where the words of each stand."""

    hashes: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)

    def words(self, at: np.ndarray | None = None) -> Iterator[bytes]:
        """The words of the shingles (or of those at ``at``), by hash."""
        starts = self.starts if at is None else self.starts[at]
        ends = self.ends if at is None else self.ends[at]
        return (self.data[low:high] for low, high in zip(starts.tolist(), ends.tolist()))

    @cached_property
    def digest(self) -> bytes | None:
        """A digest of the words of all shingles; no word holds a line feed."""
        if not len(self):
            return None
        made = hashlib.blake2b(digest_size=16)
        for some in batched(self.words(), SLICE_SHINGLES):
            made.update(b"\n".join(some) + b"\n")
        return made.digest()

    def shared(self, other: ShingleSet) -> int:
        """How many shingles both hold, compared word by word."""
        _, mine, its = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        return sum(a == b for a, b in zip(self.words(mine), other.words(its)))


def full_sets(texts: list[str | None]) -> Iterator[ShingleSet]:
    """The shingle set of each text."""
    at = 0
    while at < len(texts):
        chunk, size = [], 0
        while at < len(texts) and (not chunk or size < SLICE_BYTES):
            # These methods of bytes lower A-Z and split at ASCII white space.
            raw = (texts[at] or "").encode("utf-8", "surrogatepass").lower()
            chunk.append(b" ".join(raw.split()))
            size += len(chunk[-1]) + 1
            at += 1
        data = b" ".join(chunk) + b" "
        inside = np.frombuffer(data, dtype=np.uint8) != 32
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        words = word_hashes(data, starts, ends)
        firsts = np.concatenate([[0], np.cumsum([len(c) + 1 for c in chunk])])
        bounds = np.searchsorted(starts, firsts).tolist()
        runs = _combined(words, WIDTH) if len(words) >= WIDTH else np.empty(0, dtype=np.uint64)
        for low, high in zip(bounds, bounds[1:]):
            count = high - low
            width = min(count, WIDTH)
            if count >= WIDTH:
                found = runs[low : high - WIDTH + 1].view(np.int64)
            else:
                found = _combined(words[low:high], count).view(np.int64) if count else np.empty(0, dtype=np.int64)
            hashes, first = np.unique(found, return_index=True)
            first += low
            yield ShingleSet(hashes, data, starts[first], ends[first + width - 1] if count else first)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (int64) of each text."""
    return (found.hashes for found in full_sets(texts))


def shared(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return 0
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum())
