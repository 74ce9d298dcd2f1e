"""Content-defined anchors: a lossless sieve for equal strings of ``LENGTH`` bytes.

The anchor of a window (string of ``LENGTH`` bytes) is its k-gram of least hash, the leftmost of several. Equal windows have equal
anchors at the same place, wherever they stand. Successive windows with one anchor form a stretch. So all copies of a window
lie in stretches with the same anchor hash, and stretches whose anchor occurs once hold nothing that is repeated.

A k-gram that stands in many surroundings makes a poor anchor: all its stretches would meet in one place. ``Common`` k-grams are anchors only of windows that have no
others. Equal windows have equal k-grams, so any choice of common ones keeps the sieve lossless.
"""

from __future__ import annotations

import numpy as np

from .shingles import U, mix

LENGTH = 100
GRAM = 20
#: Bytes that are hashed at once: few enough for a processor's cache.
PIECE = (1 << 16) - LENGTH
_rng = np.random.default_rng(1700)
VALUE = _rng.integers(1, 1 << 63, 256, dtype=U)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _powers:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full((1 << 20) + 1, b, U)
            p[0] = U(1)
            _powers.append(np.cumprod(p))
    return _powers


def sums(part: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` gives the hash of any part of a piece."""
    return np.concatenate((np.zeros(1, U), np.cumsum(VALUE[part] * powers()[0][: len(part)])))


def spans(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers()[1][start] + (end - start).astype(U))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, U)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    head = np.minimum.accumulate(grid, 1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


class Common:
    """A set of k-gram hashes, tested in bulk."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(U))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams >> U(44)).astype(np.int64)] = True

    def last(self, gram: np.ndarray) -> np.ndarray:
        """Hashes of which those of common k-grams are greater than all others."""
        at = np.flatnonzero(self.maybe[(gram >> U(44)).astype(np.int64)])
        found = self.grams[np.minimum(np.searchsorted(self.grams, gram[at]), len(self.grams) - 1)] == gram[at]
        gram = gram >> U(1)
        gram[at[found]] |= U(1 << 63)
        return gram


def gram_hashes(total: np.ndarray, n: int) -> np.ndarray:
    """Hash of the k-gram at each place but the last ones, by the ``sums`` of n bytes. Its high digits are well mixed, which is all that a choice of the least needs."""
    return (total[GRAM:] - total[: n - GRAM + 1]) * (powers()[1][: n - GRAM + 1] * U(0x9FB21C651E98DF25))


def grams(part: np.ndarray) -> np.ndarray:
    return gram_hashes(sums(part), len(part))


def stretches(blob: np.ndarray, ends: np.ndarray, common: Common | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``blob``: bytes of documents, one after the other; ``ends``: where each one ends. Of each stretch: hash of its anchor, hash of all that it
    holds and where the anchor stands, start of its first window, number of windows. Windows lie within a document."""
    out = [[], [], [], []]
    for at in range(0, max(0, len(blob) - LENGTH + 1), PIECE):
        part = blob[at : at + PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        total = sums(part)
        gram = gram_hashes(total, len(part))
        i = np.arange(len(gram))
        if common is not None and len(common.grams):
            gram = common.last(gram)
        key = (gram & ~U(0xFFFFF)) | i.astype(U)
        place = (window_min(key, LENGTH - GRAM + 1) & U(0xFFFFF)).astype(np.int64)
        doc = np.searchsorted(ends, [at, at + len(part)], side="right")
        local = ends[doc[0] : doc[1] + 1] - at
        bad = np.zeros(len(place) + 1, np.int32)  # a window that holds a document's end and goes on
        lo = np.clip(local - LENGTH + 1, 0, len(place))
        hi = np.clip(local, 0, len(place))
        np.add.at(bad, lo, 1)
        np.add.at(bad, hi, -1)
        ok = np.cumsum(bad[:-1]) == 0
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(place)))
        keep = ok[first]
        first, count = first[keep], count[keep]
        p = place[first]
        out[0].append(gram[p])
        out[1].append(mix(spans(total, first, first + count + LENGTH - 1) + (p - first).astype(U) * U(0xA0761D6478BD642F)))
        out[2].append(first + at)
        out[3].append(count)
    if not out[0]:
        z = np.zeros(0, np.int64)
        return z.astype(U), z.astype(U), z, z
    return tuple(np.concatenate(x) for x in out)
