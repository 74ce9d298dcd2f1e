"""Word shingles as 64-bit numbers, vectorised over many texts."""

from __future__ import annotations

import hashlib

import numpy as np

SIZE = 5
SLICE = 1 << 20
LONG_WORD = 64
U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
UNBASE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        both = []
        for base in (BASE, UNBASE):
            p = np.full(size, base, U)
            p[0] = U(1)
            both.append(np.cumprod(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run of anything but ASCII white space) of a blob, slice by slice."""
    hashes, places, at = [], [], 0
    view = np.frombuffer(blob, np.uint8)
    while at < len(blob):
        end = min(len(blob), at + SLICE)
        if end < len(blob):
            cut = np.flatnonzero(IS_SPACE[view[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a word longer than a slice
                while end < len(blob) and not IS_SPACE[view[end]]:
                    end += 1
        part = view[at:end]
        inside = ~IS_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            p, q = powers(len(part))
            total = np.concatenate((np.zeros(1, U), np.cumsum(BYTE[part] * p)))
            h = mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U))
            for i in np.flatnonzero(ends - starts > LONG_WORD):
                h[i] = int.from_bytes(hashlib.blake2b(part[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
            hashes.append(h)
            places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def chained(words: list[np.ndarray]) -> np.ndarray:
    h = mix(words[0] + U(len(words)))
    for w in words[1:]:
        h = mix(h * U(0xD6E8FEB86659FD93) + w)
    return h


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted: runs of ``size`` words, A-Z lower-cased; fewer words are one shingle, none no shingle."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # about a slice of text at a time
        end, total, parts = at, 0, []
        while end < len(texts) and (not parts or total + len(texts[end]) < SLICE // 2):
            parts.append(texts[end].encode("utf-8", "surrogatepass").lower())
            total += len(parts[-1])
            end += 1
        h, places = word_hashes(b"\n".join(parts))
        bounds = np.searchsorted(places, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        runs = chained([h[i : len(h) - size + 1 + i] for i in range(size)]) if len(h) >= size else np.zeros(0, U)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                out.append(chained([h[i : i + 1] for i in range(a, b)]))
            else:
                out.append(np.zeros(0, U))
        at = end
    return out
