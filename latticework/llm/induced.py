"""External suffix sorting by induction, with common prefixes, in bounded memory.

The text is a row of small numbers (symbols), closed by a least one. Its suffixes are L (larger than their successor) or S; an S suffix after an
L one is LMS. Sorted LMS suffixes seed one sweep over the buckets upwards, which induces all L suffixes, and one downwards, which induces all S
suffixes. What a sweep induces waits in a ``Queue``: a priority queue whose priority is (symbol, time of arrival), so a bucket is a list of runs,
on disk beyond ``memory`` entries. A run's entries are handled as arrays.

Entries are tuples (position, common prefix with the entry before, symbols before the position). The symbols tell the suffix that an entry
induces, its type and its bucket, so a sweep reads the text only where a tuple's symbols are used up. The common prefix of two entries induced
one after the other into a bucket is 1 more than the least common prefix between their sources, a range minimum over the entries swept.

LMS suffixes are sorted by recursion: LMS substrings are sorted by the same two sweeps and named by comparing their symbols, and the row
of names is sorted by the same induction, until it has at most ``BASE`` times ``memory`` entries; then ranks of several names together are sorted. Order and common prefixes are exact up to
``cap`` symbols; beyond, order is arbitrary.

Everything as long as the text (text, LMS suffixes, names, L suffixes between the sweeps) is an array in memory up to ``memory`` entries and a mapped file
beyond; the result comes in runs, last suffix first. What stays in memory is ``memory`` entries some times, and some words for each distinct symbol.
The files are private to a task and unlinked at once, as Spark's own spill files: when an executor is lost its task begins anew elsewhere.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Entries (of 9 bytes for a text of bytes) that a queue holds in memory, and that an array may have to be kept there.
MEMORY = 200_000
#: A row of names is sorted in memory if it has at most so many times that; its ranks take 8 bytes an entry a few times.
BASE = 8
#: Symbols from which on buckets are swept in blocks.
MANY = 4096
NONE = np.int32(1 << 30)
EMPTY = np.zeros(0, np.int64)


def scratch_file():
    """An unlinked file in the folder that Spark gave this worker for its own spills."""
    folders = (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or "").split(",")
    return tempfile.TemporaryFile(dir=next((f for f in folders if f and os.access(f, os.W_OK)), None))


def place(n: int, kind, memory: int) -> np.ndarray:
    """An array of zeros: in memory if it is short, else a mapped file."""
    return np.zeros(n, kind) if n <= memory else mapped(scratch_file(), kind, n, "w+")


def mapped(file, kind, n: int, mode: str) -> np.ndarray:
    """A file as a plain array."""
    return np.memmap(file, kind, mode, shape=(n,)).view(np.ndarray)


class Rows:
    """A column that grows: in memory while it is short, then a file."""

    def __init__(self, kind, memory: int):
        self.kind, self.memory, self.parts, self.n, self.disk = np.dtype(kind), memory, [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.parts.append(np.array(x, self.kind))
        self.n += len(x)
        if self.n > self.memory:
            self.disk = self.disk or scratch_file()
            for p in self.parts:
                self.disk.write(p.tobytes())
            self.parts = []

    def array(self) -> np.ndarray:
        if self.disk is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self.disk.flush()
        return mapped(self.disk, self.kind, self.n, "r")


class Queue:
    """Runs of tuples by bucket, in order of arrival. Beyond ``budget`` entries in memory all runs go to disk."""

    def __init__(self, budget: int = MEMORY):
        self.runs: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        self.files: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.held, self.budget = 0, budget
        self.disk, self.kinds = None, ()
        self.spilled = 0

    def push(self, bucket: int, *columns: np.ndarray) -> None:
        self.runs[bucket].append(columns)
        self.held += len(columns[0])
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        self.disk = self.disk or scratch_file()
        for bucket, runs in self.runs.items():
            columns = [np.concatenate(c) for c in zip(*runs, strict=True)]
            self.kinds = tuple(c.dtype for c in columns)
            self.disk.seek(0, os.SEEK_END)
            self.files[bucket].append((self.disk.tell(), len(columns[0])))
            for c in columns:
                self.disk.write(c.tobytes())
            self.spilled += len(columns[0])
        self.runs.clear()
        self.held = 0

    def take(self, bucket: int) -> tuple[np.ndarray, ...] | None:
        """The next entries of a bucket, about ``budget`` at most; None if there are none at present."""
        parts, n = [], 0
        files = self.files.get(bucket)
        while files and n < self.budget:
            at, size = files.pop(0)
            self.disk.seek(at)
            parts.append(tuple(np.frombuffer(self.disk.read(k.itemsize * size), k) for k in self.kinds))
            n += size
        if not parts:
            parts = self.runs.pop(bucket, [])
            self.held -= sum(len(r[0]) for r in parts)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None

    def pop(self, bucket: int) -> tuple[np.ndarray, ...]:
        """All that has arrived in a bucket, in order; the bucket is empty then."""
        found = []
        while (x := self.take(bucket)) is not None:
            found.append(x)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (EMPTY, EMPTY.astype(np.int32))

    def close(self) -> None:
        if self.disk is not None:
            self.disk.close()


class Runs:
    """The same for very many buckets: runs sorted by (key, time of arrival), taken from the least key on. A few short runs are merged into one; beyond
    ``budget`` entries in memory all are merged into one on disk."""

    FEW = 16

    def __init__(self, budget: int = MEMORY):
        self.budget, self.disk, self.old, self.young, self.held, self.spilled = budget, [], [], [], 0, 0

    def push(self, key: np.ndarray, *columns: np.ndarray) -> None:
        """``key``: sorted."""
        if len(key):
            self.young.append([0, (key, *columns)])
            self.held += len(key)
            if len(self.young) > self.FEW:
                self.old.append(self.merged(self.young))
                self.young = []
            if self.held > self.budget:
                _, columns = self.merged(self.old + self.young)
                self.spilled += len(columns[0])
                on_disk = []
                for c in columns:
                    on_disk.append(place(len(c), c.dtype, 0))
                    on_disk[-1][:] = c
                self.disk.append([0, tuple(on_disk)])
                self.old, self.young, self.held = [], [], 0

    @staticmethod
    def merged(runs: list) -> list:
        columns = [np.concatenate(c) for c in zip(*([c[start:] for c in columns] for start, columns in runs), strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return [0, tuple(c[order] for c in columns)]

    def upto(self, key: int, remove: bool, most: int | None = None) -> tuple[np.ndarray, ...] | None:
        """Entries of no greater key, in order of arrival; with ``most`` about so many of them."""
        parts, n = [], 0
        for run in (*self.disk, *self.old, *self.young):
            start, columns = run
            end = int(np.searchsorted(columns[0], key, side="right"))
            if end > start and (most is None or n < most):
                parts.append([np.asarray(c[start:end]) for c in columns])
                n += end - start
                if remove:
                    run[0] = end
        if remove:
            self.disk, self.old, self.young = ([x for x in runs if x[0] < len(x[1][0])] for runs in (self.disk, self.old, self.young))
            self.held = sum(len(x[1][0]) - x[0] for x in (*self.old, *self.young))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None


class Minima:
    """Least value of the batches after a given one."""

    def __init__(self):
        self.batch, self.numbers, self.values = 0, [], []

    def add(self, value: int) -> None:
        self.batch += 1
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.numbers.pop()
        self.values.append(value)
        self.numbers.append(self.batch)

    def since(self, batch: int) -> int:
        i = bisect_right(self.numbers, batch)
        return self.values[i] if i < len(self.values) else int(NONE)


class Text:
    """Symbols from 1 (``t``, closed by the only 0; bytes are followed by eight more zeros)."""

    def __init__(self, t: np.ndarray, n: int, alphabet: int, cap: int, memory: int):
        self.t, self.n, self.alphabet, self.cap, self.memory = t, n, alphabet, cap, memory
        self.bits = max(1, (alphabet - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.carried = max(1, 30 // self.bits)
        # short types keep tuples, and so the files, small: 9 bytes for a text of bytes
        self.word = np.int32 if self.bits * self.carried <= 30 else np.int64
        self.where = np.int32 if n < 1 << 31 else np.int64
        self.common_kind = np.uint8 if cap < 255 else np.int32
        self.small = np.uint8 if alphabet <= 256 else np.uint16 if alphabet <= 65536 else np.int64
        self.wide = np.ndarray((n,), "<u8", buffer=t, strides=(1,)) if t.dtype == np.uint8 else None

    def before(self, positions: np.ndarray) -> np.ndarray:
        """A mark, then symbols before each position, the nearest lowest; 0 before the text's start."""
        out = np.ones(len(positions), self.word)
        for j in range(self.carried, 0, -1):
            at = positions - j
            s = self.t[np.maximum(at, 0)].astype(self.word)
            s[at < 0] = 0
            out = (out << self.bits) | s
        return out

    def run(self, p: int) -> int:
        """Length of the run of the symbol at p, up to the cap."""
        part = self.t[p : min(p + self.cap, self.n)]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Common prefixes of suffixes at different positions, up to the cap, looked at no further than ``most``."""
        out = np.zeros(len(a), np.int32)
        most = np.full(len(a), self.cap) if most is None else most
        live, j = np.arange(len(a)), 0
        while len(live) and j < self.cap:
            if self.wide is not None:
                x = self.wide[np.minimum(a[live] + j, self.n - 1)] ^ self.wide[np.minimum(b[live] + j, self.n - 1)]
                low = x & (~x + np.uint64(1))
                same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int32)
                step = 8
            else:
                last = self.n - 1
                same = (self.t[np.minimum(a[live] + j, last)] == self.t[np.minimum(b[live] + j, last)]).astype(np.int32)
                step = 1
            out[live] += same
            j += step
            live = live[(same == step) & (most[live] > j)]
        return np.minimum(out, self.cap)

    def lms(self) -> np.ndarray:
        """LMS positions, sorted."""
        parts, t, carry, end = [], self.t, True, self.n - 1
        rows = Rows(self.where, self.memory)
        rows.add(np.array([self.n - 1])) if self.n > 1 else None
        while end > 0:  # positions start .. end-1, backwards
            start = max(0, end - self.memory)
            x = np.asarray(t[start : end + 1])
            differs = x[:-1] != x[1:]
            at = np.where(differs, np.arange(len(differs)), len(differs))
            nxt = np.minimum.accumulate(at[::-1])[::-1]
            is_s = np.append(x[:-1] < x[1:], carry)[nxt]
            previous = np.concatenate(([t[start - 1] if start else 0], x[:-2]))
            rows.add(np.flatnonzero(is_s & (previous > x[:-1]))[::-1] + start)
            carry, end = bool(is_s[0]), start
        found = rows.array()
        out = place(len(found), self.where, self.memory)
        for a in range(0, len(found), self.memory):
            part = found[a : a + self.memory]
            out[len(found) - a - len(part) : len(found) - a] = part[::-1]
        del parts
        return out


def pieces(n: int, size: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def sweep(text: Text, symbols: np.ndarray, seeds, up: bool, queue: Queue, prefixed: bool) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Induce the L suffixes from LMS ones (``up``) or the S suffixes from L ones. ``seeds(c)`` gives runs of a bucket's seeds, which come after what is induced into it, in
    the direction of the sweep. Yields (seed or induced, bucket, positions, prefixes, symbols before) in that direction."""
    minima, tails = Minima(), {}

    def induce(c: int, positions: np.ndarray, prefixes: np.ndarray, before: np.ndarray, seed: bool) -> np.ndarray:
        used = before == 1
        if used.any():
            before = before.copy()
            before[used] = text.before(positions[used])
        s = before & text.mask
        if up:
            ok = s >= max(c, 1)
        else:
            ok = (s > 0) & ((s < c) if seed else (s <= c))
        at = np.flatnonzero(ok)
        now = minima.batch + 1
        if not len(at):
            minima.add(int(prefixes.min()) if prefixed else 0)
            return before
        target = s[at].astype(text.small)
        order = np.argsort(target, kind="stable")
        target, at = target[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        ends = np.append(cuts[1:], len(target))
        if prefixed:
            # least prefix over (source of the last one, own source]; of the first of a bucket from the start of the batch
            start = np.concatenate(([0], at[:-1] + 1))
            start[cuts] = 0
            ext = np.append(prefixes.astype(np.int32), NONE)
            low = np.minimum.reduceat(ext, np.stack((start, at + 1), 1).ravel())[::2]
        else:
            low = np.zeros(len(at), np.int32)
        where, rest = positions[at] - 1, before[at] >> text.bits
        for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
            bucket, last = int(target[a]), int(at[b - 1])
            if prefixed:
                if bucket in tails:  # since the last one that was induced into the bucket
                    batch, tail = tails[bucket]
                    low[a] = min(int(low[a]), tail, minima.since(batch))
                else:
                    low[a] = -1
                tails[bucket] = (now, int(prefixes[last + 1 :].min()) if last + 1 < len(prefixes) else int(NONE))
            queue.push(bucket, where[a:b], np.minimum(low[a:b] + 1, text.cap).astype(text.common_kind), rest[a:b])
        minima.add(int(prefixes.min()) if prefixed else 0)
        return before

    for c in symbols.tolist():
        last = None
        while (found := queue.take(c)) is not None:
            positions, prefixes, before = found
            before = induce(c, positions, prefixes, before, False)
            last = int(positions[-1])
            yield False, c, positions, prefixes, before
        first = True
        for positions, prefixes, before in seeds(c):
            if first:  # between an L and an S suffix of one bucket: the shorter run of its symbol
                prefixes = prefixes.copy()
                prefixes[0] = min(text.run(last), text.run(int(positions[0]))) if prefixed and last is not None else 0
                first = False
            before = induce(c, positions, prefixes, before, True)
            yield True, c, positions, prefixes, before


def induced(text: Text, symbols: np.ndarray, counts: np.ndarray, lms: np.ndarray, prefix: np.ndarray | None, spilled: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """All suffixes, the greatest first, given LMS suffixes in order and their prefixes (None: of no interest): bucket, positions, prefixes with the one before in this order,
    symbols before, whether they are S."""
    ends = np.cumsum(counts)
    prefixed = prefix is not None
    rows = tuple(Rows(k, text.memory) for k in (text.where, text.common_kind, text.word))
    bounds: dict[int, tuple[int, int]] = {}

    def lms_seeds(c: int):
        for a in range(int(ends[c] - counts[c]), int(ends[c]), text.memory):
            positions = np.asarray(lms[a : min(int(ends[c]), a + text.memory)])
            yield positions, np.asarray(prefix[a : a + len(positions)]) if prefixed else np.zeros(len(positions), text.common_kind), text.before(positions)

    queue = Queue(text.memory)
    for seed, c, *columns in sweep(text, symbols, lms_seeds, True, queue, prefixed):
        if not seed:
            n = rows[0].n
            for r, x in zip(rows, columns, strict=True):
                r.add(x)
            bounds[c] = (bounds.get(c, (n, n))[0], rows[0].n)
    spilled[0] += queue.spilled
    queue.close()
    larger = [r.array() for r in rows]

    def l_seeds(c: int):
        start, end = bounds.get(c, (0, 0))
        for b in range(end, start, -text.memory):
            a = max(start, b - text.memory)
            x = np.asarray(larger[1][a + 1 : b + 1]) if b < end else np.append(larger[1][a + 1 : b], 0).astype(text.common_kind)
            yield np.asarray(larger[0][a:b])[::-1], x[::-1], np.asarray(larger[2][a:b])[::-1]

    queue = Queue(text.memory)
    for seed, c, positions, prefixes, before in sweep(text, symbols[::-1], l_seeds, False, queue, prefixed):
        yield c, positions, prefixes, before, not seed
    spilled[0] += queue.spilled
    queue.close()


def block_sweep(text: Text, symbols: np.ndarray, seeds, up: bool, queue: Runs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``sweep`` without prefixes for an alphabet of very many symbols: a block of buckets at once, up to the first one that an entry of the block induces into.
    ``seeds(x, y)``: (symbols, positions, symbols before) of the buckets x to y of ``symbols``. Yields (symbols, positions, symbols before, which are seeds)."""
    sign = 1 if up else -1
    keys = symbols if up else -symbols[::-1]
    most, i, step = len(keys), 0, 64
    none = (EMPTY, EMPTY, EMPTY)
    yes, no = (lambda c: np.ones(len(c), bool)), (lambda c: np.zeros(len(c), bool))

    def induce(c: np.ndarray, positions: np.ndarray, before: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols before, which entries induce one, and the keys of those."""
        used = before == 1
        if used.any():
            before = before.copy()
            before[used] = text.before(positions[used])
        s = before & text.mask
        ok = s >= np.maximum(c, 1) if up else (s > 0) & np.where(seed, s < c, s <= c)
        return before, ok, s * sign

    def push(positions: np.ndarray, before: np.ndarray, ok: np.ndarray, target: np.ndarray) -> None:
        at = np.flatnonzero(ok)
        at = at[np.argsort(target[at], kind="stable")]
        queue.push(target[at], positions[at] - 1, before[at] >> text.bits)

    while i < most:
        j = min(most, i + step)
        found, more = queue.upto(int(keys[j - 1]), False) or none, seeds(keys[i:j] * sign)
        key = np.concatenate((found[0], more[0] * sign))
        order = np.argsort(key, kind="stable")  # seeds come after what was induced into their bucket
        key, seed = key[order], (np.arange(len(key)) >= len(found[0]))[order]
        positions, before = (np.concatenate((found[k], more[k]))[order] for k in (1, 2))
        before, ok, target = induce(key * sign, positions, before, seed)
        within = target[ok & (target <= keys[j - 1])]
        first = int(within.min()) if len(within) else None
        if first is not None and first <= keys[i]:  # into the first bucket itself: that one alone, round by round
            while (found := queue.upto(int(keys[i]), True, text.memory)) is not None:
                c = found[0] * sign
                before, ok, target = induce(c, found[1], found[2], no(c))
                push(found[1], before, ok, target)
                yield c, found[1], before, no(c)
            c, positions, before = seeds(keys[i : i + 1] * sign)
            if len(c):
                before, ok, target = induce(c, positions, before, yes(c))
                push(positions, before, ok, target)
                yield c, positions, before, yes(c)
            i += 1
            continue
        if first is None:
            step = min(step * 2, max(64, text.memory // 8))
        else:
            j = int(np.searchsorted(keys, first))
            step = max(16, 2 * (j - i))
            final = key < first
            key, seed, positions, before, ok, target = (x[final] for x in (key, seed, positions, before, ok, target))
        queue.upto(int(keys[j - 1]), True)
        push(positions, before, ok, target)
        if len(key):
            yield key * sign, positions, before, seed
        i = j


def ordered(text: Text, symbols: np.ndarray, counts: np.ndarray, lms: np.ndarray, spilled: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """``induced`` without prefixes, by blocks of buckets: symbols, positions, symbols before, which are S."""
    ends = np.cumsum(counts)
    rows = tuple(Rows(k, text.memory) for k in (np.int32 if text.alphabet < 1 << 31 else np.int64, text.where, text.word))

    def lms_seeds(c: np.ndarray):
        a, b = int(ends[c[0]] - counts[c[0]]), int(ends[c[-1]])
        positions = np.asarray(lms[a:b])
        return np.repeat(c, counts[c]), positions, text.before(positions)

    queue = Runs(text.memory)
    for c, positions, before, seed in block_sweep(text, symbols, lms_seeds, True, queue):
        for x, y in zip(rows, (c, positions, before), strict=True):
            x.add(y[~seed])
    spilled[0] += queue.spilled
    larger = [x.array() for x in rows]

    def l_seeds(c: np.ndarray):  # from the greatest symbol down
        a, b = np.searchsorted(larger[0], [c[-1], c[0] + 1])
        return tuple(np.asarray(x[a:b])[::-1] for x in larger)

    queue = Runs(text.memory)
    for c, positions, before, seed in block_sweep(text, symbols, l_seeds, False, queue):
        yield c, positions, before, ~seed
    spilled[0] += queue.spilled


def by_symbol(text: Text, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions by their first symbol, and how many there are of each."""
    counts = np.zeros(text.alphabet, np.int64)
    for a, b in pieces(len(lms), text.memory):
        counts += np.bincount(text.t[lms[a:b]], minlength=text.alphabet)
    out, free = place(len(lms), text.where, text.memory), np.cumsum(counts) - counts
    for a, b in pieces(len(lms), text.memory):
        part = np.asarray(lms[a:b])
        s = text.t[part].astype(text.small)
        order = np.argsort(s, kind="stable")
        s = s[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(first, len(s)))
        out[free[s] + np.arange(len(s)) - np.repeat(first, size)] = part[order]
        free[s[first]] += size
    return out, counts


def named(text: Text, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in order of the text, from their sorted ``order``: equal ones lie side by side. Also the number of names."""
    out = place(len(lms), np.int32, text.memory)
    name, last = -1, None
    for a, b in pieces(len(order), text.memory):
        part = np.asarray(order[a:b])
        at = np.searchsorted(lms, part)
        size = np.minimum(np.asarray(lms[np.minimum(at + 1, len(lms) - 1)]) - part + 1, text.cap)
        x, n = (part, size) if last is None else (np.append(last[0], part), np.append(last[1], size))
        least = np.minimum(n[1:], n[:-1])
        new = (n[1:] != n[:-1]) | (text.common(x[:-1], x[1:], least) < least)
        if last is None:
            new = np.append(True, new)
        names = name + np.cumsum(new)
        out[at] = names
        name, last = int(names[-1]), (part[-1:], size[-1:])
    return out, name + 1


def multiplied(names: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of a row of names by their first ``cap`` ones, in memory: ranks of so many names as fit into 63 bits, then of so many such ranks, until they reach."""
    n, reach = len(names), 1
    names = names.astype(np.int64) + 1  # 0 stands for the end
    bits = n.bit_length()
    at_once = max(2, 63 // bits)
    order = None
    while order is None or (reach < cap and names.max() < n):
        k = min(at_once, -(-cap // reach)) if cap > 1 else 1
        key = names.copy()
        for j in range(1, k):
            key <<= bits
            key[: max(0, n - j * reach)] |= names[j * reach :]
        order = np.argsort(key)  # equal ones get one rank, in whatever order they come
        sorted_key = key[order]
        names = np.empty(n, np.int64)
        names[order] = np.cumsum(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
        reach *= k
    return order


def suffixes(text: Text, spilled: list[int], prefixed: bool = True, depth: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (positions, prefixes): all suffixes but that of the closing symbol, the greatest first, each with its common prefix with the one before."""
    if text.n < 2:
        return
    lms = text.lms()
    seeds, counts = by_symbol(text, lms)
    present = np.zeros(text.alphabet, bool)
    for a, b in pieces(text.n, text.memory):
        present[text.t[a:b]] = True
    symbols = np.flatnonzero(present)
    if len(lms) > 2:
        found = Rows(text.where, text.memory)
        if text.alphabet > MANY:
            swept = ((c[is_s], positions[is_s], before[is_s]) for c, positions, before, is_s in ordered(text, symbols, counts, seeds, spilled))
        else:
            swept = ((c, positions, before) for c, positions, _, before, is_s in induced(text, symbols, counts, seeds, None, spilled) if is_s)
        for c, positions, before in swept:
            found.add(positions[(before & text.mask) > c])
        found.add(np.array([text.n - 1]))
        swept = found.array()
        order = place(len(lms), text.where, text.memory)
        for a, b in pieces(len(lms), text.memory):
            order[len(lms) - b : len(lms) - a] = np.asarray(swept[a:b])[::-1]
        names, many = named(text, lms, order)
        if many < len(lms):
            if len(names) <= BASE * text.memory:
                ranks = multiplied(names, text.cap // 2 + 1)
            else:
                if depth is not None:
                    depth[0] += 1
                row = Text(names, len(names), many, text.cap // 2 + 1, text.memory)
                ranks, end = place(len(lms), text.where, text.memory), len(lms)
                for positions, _ in suffixes(row, spilled, False, depth):
                    ranks[end - len(positions) : end] = positions[::-1]
                    end -= len(positions)
                ranks[0] = len(lms) - 1
            for a, b in pieces(len(lms), text.memory):
                order[a:b] = lms[ranks[a:b]]
    else:
        order = seeds
    if not prefixed and text.alphabet > MANY:
        for _, positions, _, _ in ordered(text, symbols, counts, order, spilled):
            yield positions, np.zeros(len(positions), np.int32)
        return
    prefix = None
    if prefixed:
        prefix = place(len(lms), text.common_kind, text.memory)
        for a, b in pieces(len(lms) - 1, text.memory):
            prefix[a + 1 : b + 1] = text.common(np.asarray(order[a:b]), np.asarray(order[a + 1 : b + 1]))
    for _, positions, prefixes, _, _ in induced(text, symbols, counts, order, prefix, spilled):
        yield positions, prefixes


def prepared(symbols: np.ndarray, cap: int, memory: int) -> Text:
    """The text of a row of numbers from 0."""
    alphabet = int(symbols.max()) + 2 if len(symbols) else 1
    kind = np.uint8 if alphabet <= 256 else np.int32
    t = place(len(symbols) + 9, kind, memory)
    for a, b in pieces(len(symbols), memory):
        t[a:b] = symbols[a:b] + 1
    return Text(t, len(symbols) + 1, alphabet, cap, memory)


def suffix_array(symbols: np.ndarray, cap: int, budget: int = MEMORY) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of all suffixes by their first ``cap`` symbols, each one's common prefix with the one before (right up to ``cap``),
    and how many entries went through disk. ``symbols`` are 0 or more."""
    spilled = [0]
    found = list(suffixes(prepared(symbols, cap, budget), spilled))
    if not found:
        return EMPTY, EMPTY.astype(np.int32), 0
    order, prefix = (np.concatenate(c)[::-1] for c in zip(*found, strict=True))
    return order, np.concatenate(([0], prefix[:-1])), spilled[0]
