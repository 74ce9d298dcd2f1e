"""Exact removal of repeated strings of 100 bytes, by external suffix sorting of shards.

A byte goes if a string of 100 bytes that covers it also starts earlier (in a document of smaller id, or earlier in the same one).

1. ``stretches``: every window of 100 bytes belongs to a stretch, found by content-defined anchors (see ``anchors``). Windows whose anchor occurs once can't
   repeat. One pass before it counts, batch by batch, the k-grams that stand in many surroundings; these are no anchors where others will do.
2. Stretches meet by the hash of their anchor. Of equal stretches (by 128 bits of digest) the first two are open, as is every stretch whose anchor another one has;
   from the third on equal stretches are repeats if the second is, which needs no more bytes. They go already within a batch, so a hot passage or a
   large group of copies reaches the shuffle twice for each batch.
3. Open stretches are cut out of their documents and dealt to shards by anchor, so equal windows share a shard. There, windows whose hash comes
   once are left out. Each shard is sorted by external induction (see ``induced``): disk-backed queues carry suffixes and common prefixes, recursion sorts the
   names; text, names and result lie on disk beyond ``memory`` entries. Neighbours in suffix order with a common prefix of 100 or more are equal
   windows, by their bytes; the earliest stays, the others are repeats. A shard is closed at ``SHARD_BYTES`` but never within an anchor; an anchor with more than
   that makes a longer shard, not more memory.
4. Repeats are merged per document and its bytes without them are kept.

Anchors and hashes are lossless sieves: equal windows have equal ones, so the sort sees all windows whose fate isn't clear. Sorting all
suffixes of all documents instead would need more disk than there is (5 bytes and more of suffix array for each byte of text).

Edge cases: null and empty texts have no bytes and no repeats; a very long text is cut and hashed whole in one worker's memory, piece by piece; rows are ordered by
id (null first), then text, so of equal rows or rows of one id each has its place; documents under 100 bytes are kept whole; an empty table
gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import GRAM, LENGTH, PIECE, Common, grams, spans, stretches, sums
from .common import get_bucketed, put_bucketed, scratch, slices, stored, table, tidied
from .induced import MEMORY, NONE, Rows, Text, pieces, place, suffixes
from .shingles import U, mix

#: Bytes that are sorted together, bytes of open stretches in a task, and bytes of which windows with a hash of their own are left out together.
SHARD_BYTES, TASK_BYTES, SIEVE_BYTES = 2_000_000, 4_000_000, 2_000_000
#: Surroundings in a batch that make an anchor hot, and most k-grams in the common class, those of highest count. Any choice gives right results; 1.6 MB are sent to each worker.
HOT_LEAST, COMMON_MOST = 64, 100_000
BATCH_BYTES = 16_000_000
#: Rows of stretches: hash of the anchor, of all that the stretch holds, document, and place and number of windows in one number, negative if the windows are known to be repeats.
COLUMNS, ROW = ["h", "c", "v", "at"], "h long, c long, v long, at long"
COUNT_BITS = 21


def ranges_merged(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Successive ranges (start, count), sorted, that touch or overlap become one."""
    if not len(a):
        return a, n
    end = np.maximum.accumulate(a + n)
    new = np.concatenate(([True], a[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return a[first], end[np.append(first[1:], len(a)) - 1] - a[first]


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and bytes of documents, about ``most`` bytes at a time."""
    ids, data, size = [], [], 0
    for batch in slices(batches):
        for v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            b = (t or "").encode("utf-8", "surrogatepass")
            ids.append(v)
            data.append(b)
            size += len(b)
            if size >= most:
                yield np.array(ids, np.int64), data
                ids, data, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), data


def joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other, and where each one ends."""
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(b) for b in data])


def hot_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n): k-grams in ``HOT_LEAST`` or more different stretches around anchors with so many of them in the batch."""
    for _, data in grouped(batches, BATCH_BYTES):
        blob, ends = joined(data)
        h, c, at, n = stretches(blob, ends)
        by = np.lexsort((c, h))
        h, c, at, n = h[by], c[by], at[by], n[by]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        h, at, n = h[new], at[new], n[new]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        hot = np.flatnonzero(np.repeat(size >= HOT_LEAST, size))
        found = []
        for i in range(0, len(hot), 4000):
            some = [blob[a : a + k + LENGTH - 1] for a, k in zip(at[hot[i : i + 4000]].tolist(), n[hot[i : i + 4000]].tolist(), strict=True)]
            for x in (np.concatenate(some),) if some else ():
                inner = np.ones(len(x) - GRAM + 1, bool)  # not across two stretches
                for e in np.cumsum([len(p) for p in some])[:-1].tolist():
                    inner[e - GRAM + 1 : e] = False
                found.append(grams(x)[inner])
        values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, np.int64))
        often = counts >= HOT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["gram", "n"])


def packed(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << COUNT_BITS) | n


def split_runs(a: np.ndarray, n: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, count) cut into parts of fewer than 2 ** ``COUNT_BITS`` windows."""
    if not len(a) or parts.max() == 1:
        return a, n
    which = np.repeat(np.arange(len(a)), parts)
    step = -(-n // parts)
    k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = a[which] + k * step[which]
    size = np.minimum(step[which], a[which] + n[which] - start)
    return start[size > 0], size[size > 0]


def rows_of(h: np.ndarray, c: np.ndarray, v: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(v), pa.array(at)], names=COLUMNS)


def stretch_rows(common: Common):
    """Rows of ``COLUMNS``: stretches, and runs of windows known to be repeats (their h is arbitrary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in grouped(batches, BATCH_BYTES):
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], [data[i] for i in order]
            blob, ends = joined(data)
            begins = ends - np.array([len(b) for b in data])
            h, c, at, n = stretches(blob, ends, common)
            doc = np.searchsorted(ends, at, side="right")
            # stable: equal ones by document and place; where two different ones share the key, a third copy may be missed, and is sorted then
            by = np.argsort(mix(h + c * U(0xA0761D6478BD642F)), kind="stable")
            third = np.zeros(len(by), bool)
            third[2:] = (h[by][2:] == h[by][:-2]) & (c[by][2:] == c[by][:-2])
            keep, again = np.sort(by[~third]), np.sort(by[third])
            d = doc[keep]
            yield rows_of(h[keep], c[keep], ids[d], packed(at[keep] - begins[d], n[keep]))
            if len(again):
                # runs within one document: places in the blob tell documents apart, as a document's last windows start no stretch
                start, count = ranges_merged(at[again], n[again])
                parts = (count >> COUNT_BITS) + 1
                start, count = split_runs(start, count, parts)
                d = np.searchsorted(ends, start, side="right")
                spread = mix(start.astype(U) + mix(ids[d].view(U)))
                yield rows_of(spread, np.zeros(len(start), U), ids[d], -1 - packed(start - begins[d], count))

    return run


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: v, text, open (array of at, h). Output: h, v, a, bytes of the stretch."""
    for batch in slices(batches):
        lists = batch.column(2)
        ends, flat = lists.offsets.to_numpy(), lists.values
        at, h = (flat.field(k).to_numpy() for k in ("at", "h"))
        a, last = at >> COUNT_BITS, (at >> COUNT_BITS) + (at & ((1 << COUNT_BITS) - 1)) + LENGTH - 1
        v, cuts = np.repeat(batch.column(0).to_numpy(), np.diff(ends)), []
        for text, i, j in zip(batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            cuts += [data[x:y] for x, y in zip(a[i:j].tolist(), last[i:j].tolist(), strict=True)]
        inside = slice(ends[0], ends[-1])
        yield pa.RecordBatch.from_arrays([pa.array(h[inside]), pa.array(v), pa.array(a[inside]), pa.array(cuts, pa.binary())], names=["h", "v", "a", "piece"])


def repeated_parts(cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, windows): runs of windows whose hash comes twice or more in the shard. Equal windows have equal hashes, so the others need no sorting."""
    sizes = np.array([len(p) for p in cuts])
    blob = np.frombuffer(b"".join(cuts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    hashes = np.concatenate([spans(sums(part), i := np.arange(len(part) - LENGTH + 1), i + LENGTH) for at in range(0, len(blob) - LENGTH + 1, PIECE) if len(part := blob[at : at + PIECE + LENGTH - 1]) >= LENGTH])
    windows = sizes - LENGTH + 1  # each piece holds a window at least
    place = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    h = hashes[place]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = place[twice]
    piece = np.searchsorted(starts, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    return piece[first], at[first] - starts[piece[first]], np.diff(np.append(first, len(at)))


class Shard:
    """Cut-out parts of documents, to be sorted together."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.spilled, self.depth = memory, [0], [0]
        self.text = Rows(np.uint8, memory)
        self.v, self.a, self.start = (Rows(np.int64, memory) for _ in range(3))

    def add(self, v, a, cuts: list[bytes]) -> None:
        """Symbol 1 stands behind each part, so a common prefix of 100 symbols can't cross from one window into another part unnoticed. No UTF-8 text has bytes above 0xF4."""
        sizes = np.array([len(p) + 1 for p in cuts])
        self.start.add(np.cumsum(sizes) - sizes + self.text.n)
        blob = np.frombuffer(b"\xff".join(cuts) + b"\xff", np.uint8) + np.uint8(2)
        self.text.add(blob)
        self.v.add(np.asarray(v))
        self.a.add(np.asarray(a))

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs (v, start, windows) of the windows that an earlier one of the shard equals."""
        n = self.text.n
        self.text.add(np.zeros(9, np.uint8))
        t, v, a, start = (x.array() for x in (self.text, self.v, self.a, self.start))
        marks, part_of = place(n, bool, self.memory), place(n, np.int32, self.memory)
        size = np.diff(np.append(start, n))
        for x, y in pieces(len(start), max(1, self.memory // 100)):
            part_of[start[x] : start[y] if y < len(start) else n] = np.repeat(np.arange(x, y, dtype=np.int32), size[x:y])
        rank = np.empty(len(start), np.int64)  # no window is in two parts, so parts in order have their windows in order
        rank[np.lexsort((a, v))] = np.arange(len(start))
        low_before, first = int(NONE), None  # since the last window; the earliest of the group that it belongs to
        for positions, prefixes in suffixes(Text(t, n + 1, 256, LENGTH, self.memory), self.spilled, depth=self.depth):
            k = part_of[positions]
            at = np.flatnonzero(positions + LENGTH < start[k] + size[k])  # windows; the part's last symbol isn't its own
            if not len(at):
                low_before = min(low_before, int(prefixes.min()))
                continue
            # between two windows the common prefix is the least on the way
            low = np.minimum.reduceat(prefixes[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
            low[0] = min(int(low[0]), low_before)
            low_before = int(prefixes[at[-1] + 1 :].min()) if at[-1] + 1 < len(prefixes) else int(NONE)
            positions, k = positions[at].astype(np.int64), k[at]
            key = (rank[k] << 32) | (positions - start[k])
            new = low < LENGTH
            goes_on, new[0] = not new[0] and first is not None, True
            heads = np.flatnonzero(new)
            least = np.minimum.reduceat(key, heads)
            again = key != np.repeat(least, np.diff(np.append(heads, len(key))))
            marks[positions[again]] = True
            if goes_on:  # with the group of the last run
                mine = (int(least[0]), int(positions[: heads[1] if len(heads) > 1 else None][~again[: heads[1] if len(heads) > 1 else None]][0]))
                marks[max(mine, first)[1]] = True
                first = min(mine, first)
            if not goes_on or len(heads) > 1:
                first = (int(least[-1]), int(positions[heads[-1] :][~again[heads[-1] :]][0]))
        for x, y in pieces(n, max(self.memory, 1)):
            hit = np.flatnonzero(marks[x:y]) + x
            if len(hit):
                k = part_of[hit]
                new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (k[1:] != k[:-1])))
                at = np.flatnonzero(new)
                yield v[k[at]], a[k[at]] + hit[at] - start[k[at]], np.diff(np.append(at, len(hit)))


def sieved(v: np.ndarray, a: np.ndarray, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Parts of the cuts whose windows have a hash that comes twice or more."""
    which, start, count = repeated_parts(cuts)
    return v[which], a[which] + start, [cuts[k][s : s + c + LENGTH - 1] for k, s, c in zip(which.tolist(), start.tolist(), count.tolist(), strict=True)]


def shard_repeats(v: np.ndarray, a: np.ndarray, cuts: list[bytes], memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, start, windows) of the windows of a shard that an earlier one of it equals."""
    shard = Shard(memory)
    left = sieved(v, a, cuts)
    if left[2]:
        shard.add(*left)
    found = list(shard.repeats()) if shard.text.n else []
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by h: h, v, a, piece. A shard is sorted when it has ``SHARD_BYTES``, but never splits an h; one h that exceeds ``SIEVE_BYTES`` goes in without the sieve."""
    shard, held, size, mark, hot = Shard(), [], 0, None, False

    def sift() -> None:
        nonlocal held, size
        if held:
            v, a = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            cuts = [c for x in held for c in x[2]]
            left = (v, a, cuts) if hot else sieved(v, a, cuts)
            if left[2]:
                shard.add(*left)
        held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal shard
        if shard.text.n:
            for out in shard.repeats():
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in out], names=["v", "a", "n"])
        shard = Shard()

    for batch in batches:
        hs, vs, starts = (batch.column(i).to_numpy() for i in range(3))
        cuts = batch.column(3).to_pylist()
        edges = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1], [True]))) if len(hs) else np.zeros(0, np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            h = int(hs[i])
            if h != mark and hot:
                sift()
                hot = False
            if h != mark and size > SIEVE_BYTES:
                sift()
            if h != mark and shard.text.n > SHARD_BYTES:
                sift()
                yield from flush()
            mark = h
            for x in range(i, j, 1000):  # the rows of one anchor
                y = min(j, x + 1000)
                held.append((vs[x:y], starts[x:y], cuts[x:y]))
                size += sum(map(len, cuts[x:y]))
                if size > 2 * SIEVE_BYTES:
                    hot = True
                    sift()
    sift()
    yield from flush()


def without(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and the bytes that are left. ``spans``: (first window, windows), in any order."""
    removed = runs = end = 0
    kept = []
    last = -1
    for a, n in sorted(spans):
        s, e = a, a + n + LENGTH - 1
        if s > last:
            kept.append(data[end:s])
            runs += 1
        removed += e - max(s, end) if e > end else 0
        end = last = max(end, e)
    kept.append(data[end:])
    return removed, runs, b"".join(kept)


FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input: id, text, spans (array of a, n, or null). Output: ``FIELDS``."""
    for batch in slices(batches):
        out = []
        for i, t, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass")
            removed, runs, kept = without(data, [(s["a"], s["n"]) for s in spans]) if spans else (0, 0, data)
            out.append((i, len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """``v``, ``id``, ``text``: v is distinct and in the order of documents. The id itself will do unless one is null or comes twice; then rows
    are sorted and numbered."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    odd = rows.groupBy("id").count().filter("count > 1 or id is null")
    if not odd.limit(1).count():
        return rows.select(F.col("id").alias("v"), "id", "text")
    return stored(rows.sort("id", "text").withColumn("v", F.monotonically_increasing_id()).select("v", "id", "text"), "numbered")


def bucketed(rows: DataFrame) -> DataFrame:
    """The texts, dealt by ``v`` once: the two joins that follow read them where they lie."""
    spark = rows.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, "texts")
    put_bucketed(rows.select("v", "id", "text").repartition(parts, "v"), path, "v", parts)
    return get_bucketed(spark, path, "v bigint, id bigint, text string", "v", parts)


def repeats(rows: DataFrame) -> DataFrame:
    """``v``, ``a``, ``n``: runs of n windows from byte a of a document of which each also starts earlier."""
    spark = rows.sparkSession
    texts = rows.select("v", "text")
    often = texts.mapInArrow(tidied(hot_grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(COMMON_MOST)
    common = Common(np.array([r.gram for r in often.collect()], np.int64).view(U))
    made = texts.mapInArrow(tidied(stretch_rows(common)), ROW)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("h").orderBy("c", "v", "at")  # rows that look two rows back and one ahead, no frame of a whole anchor
    third = F.coalesce(F.lag("c", 2).over(w) == F.col("c"), F.lit(False))
    other = F.lag("h", 1).over(w).isNotNull() | F.lead("h", 1).over(w).isNotNull()
    met = made.repartition(parts, "h").withColumns({"third": third, "other": other}).filter("at < 0 or third or other")
    met = stored(met.select("h", "v", F.when((F.col("at") >= 0) & F.col("third"), -1 - F.col("at")).otherwise(F.col("at")).alias("at")), "stretches")

    gone, mask = -1 - F.col("at"), (1 << COUNT_BITS) - 1
    known = met.filter("at < 0").select("v", F.shiftright(gone, COUNT_BITS).alias("a"), gone.bitwiseAND(mask).alias("n"))
    unclear = met.filter("at >= 0")
    size = unclear.agg(F.sum(F.col("at").bitwiseAND(mask) + LENGTH - 1)).first()[0]
    if not size:
        return known
    tasks = max(1, -(-size // TASK_BYTES), min(parts, size // 200_000))
    listed = unclear.groupBy("v").agg(F.collect_list(F.struct("at", "h")).alias("open"))  # at most a document's own stretches
    cuts = texts.join(listed, "v").select("v", "text", "open").mapInArrow(tidied(cut_out), "h long, v long, a long, piece binary")
    dealt = cuts.repartition(int(tasks), "h").sortWithinPartitions("h", "v", "a")
    return known.unionAll(dealt.mapInArrow(tidied(sort_shards), "v long, a long, n long"))


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: ``FIELDS``."""
    rows = bucketed(numbered(docs, text, id_col))
    found = repeats(rows).groupBy("v").agg(F.collect_list(F.struct("a", "n")).alias("spans"))
    return rows.join(found, "v", "left").select("id", "text", "spans").mapInArrow(tidied(digest_rows), FIELDS).withColumnRenamed("doc_id", id_col)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
