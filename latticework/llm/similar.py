"""Near-duplicate documents: an exact Jaccard join over word shingles by token-combination prefixes.

A document is the set of its distinct 5-word shingles. Two documents link when their Jaccard similarity is 0.8 or more; a
document's class is the least id reachable by links. Shingles have one global order: rare ones first (by hash), then the class of
frequent ones (by count). Two linking documents share their least common shingle within the first n - ceil(0.8 n) + 1 of each.
If that shingle is rare it is a key of both. If it is frequent, all that they share are frequent, so their two least common
shingles lie in prefixes longer by one, and the combination of the two is a key of both. So keys are single rare shingles
and pairs of frequent ones, and a passage that many documents share brings them together only if they share little else.

1. ``sets``: size, 64-bit digest and bit map of each set, and shingles that are frequent within a batch. Equal sets are one node.
2. ``keys``: (key, set), packed by bucket of the key. A key of one set only goes. The others are split by bands of sizes, so that sets that may link by size share
   a band's key; sets that share such a key with a leader, the least of a key, form the leader's group. A key has to bring two sets together only if it can be the least that both have, so a set goes
   from a band's key if no other there fits it by size and place, and a band's key goes if the shingle before it is the same in all its sets. So each pair that links lies in a group, and near
   copies meet where they begin to agree, not at each of their keys, however many buckets there are.
3. All pairs of a group are compared: by bit maps, then exactly by whole sets those that have a partner by their maps. Large groups are cut into blocks.
4. A pair counts in the group of its least common leader only, so ``n_links`` counts each link once; no pair leaves its task, only counts and a forest of the links,
   from which connected components are taken.

Shingles and sets are 64-bit hashes: two different ones are taken for one with a chance of 2^-64 for each pair compared.

Edge cases: null and empty texts, or texts without words, have size 0 and link with nothing; with fewer than 5 words the whole
sequence is the one shingle; a very long text is cut into shingles whole, in one worker's memory (8 bytes a shingle); rows with one id are one node of the components, whatever their texts; a null id can link others but is no component id (a component of null
ids only has a null component_id); an empty table gives an empty result; extra columns are dropped by ``classes``, kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freed, fresh, slices, stored, table, tidied, tidy
from .components import components
from .shingles import U, mix, shingle_sets

PERCENT = 80
#: A shingle is frequent in a batch if a thousandth of the batch's documents have it, eight at least, ...
FREQUENT_SHARE, FREQUENT_LEAST = 0.001, 8
#: ... and in all if so many documents have it and their sizes differ by this factor (copies of one document don't).
FREQUENT_ALL, SIZE_FACTOR = 40, 2.0
#: Most shingles in the frequent class, those of highest count; any choice gives right results. 1.6 MB are sent to each worker.
FREQUENT_MOST = 100_000
BROADCAST_NODES = 500_000
#: Groups of more rows than this, and than a share of all rows that at most ``HEAVY_MOST`` groups can exceed, are joined without a shuffle.
HEAVY_LEAST, HEAVY_MOST = 1000, 100_000
#: Ratio of sizes within a band, a little over 100 / PERCENT: sets that link lie in one band or in neighbours.
BAND = 100 / PERCENT * (1 + 1e-6)
#: Sets of a group in a block (two blocks are compared at once), and bytes of text that are cut into shingles together.
BLOCK = 1000
PIECE_BYTES = 8_000_000
#: Keys in a bucket, about; rows of groups in a unit of comparison; bytes of maps, and cells of a matrix, in memory at once.
BUCKET_KEYS, UNIT_ROWS, MAP_BYTES, CELLS = 400_000, 2000, 16_000_000, 4_000_000
SPREAD = U(0xA0761D6478BD642F)
#: Steps of sizes within a band, and a number above all of them.
STEPS, ABOVE = 64, 1 << 30
#: A key, the shingle before it (0: none), its set, the set's size and the most that a partner's size can be if this is the least key of both (in steps), as they are packed.
PACKED = np.dtype([("key", "<u8"), ("before", "<u8"), ("s", "<i8"), ("size", "<i2"), ("most", "<i2")])


def needed(n):
    """Least overlap of a set of n shingles with a set that it links with."""
    return -(-PERCENT * n // 100)


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, about ``PIECE_BYTES`` at a time."""
    ids, texts, size = [], [], 0
    for part in slices(batches):
        for v, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            ids.append(v)
            texts.append(t)
            size += len(t)
            if size >= PIECE_BYTES:
                yield pa.array(ids, pa.int64()), texts
                ids, texts, size = [], [], 0
    if ids:
        yield pa.array(ids, pa.int64()), texts


def digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: document, size, digest of its set, its map; of kind 1: shingle, documents of the batch, their least and largest size."""
    names = ["kind", "v", "n", "s", "map", "low", "high"]
    for ids, texts in in_pieces(batches):
        sets = shingle_sets(texts)
        sizes = np.array([len(s) for s in sets], np.int64)
        digests = [digest(s) if len(s) else None for s in sets]
        n = len(sets)
        seen: set[int | None] = {None}
        fresh_sets = [i for i, d in enumerate(digests) if not (d in seen or seen.add(d))]  # equal sets count once
        maps: list[bytes | None] = [None] * n
        for i in fresh_sets:
            maps[i] = bitmap(sets[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), ids, pa.array(sizes), pa.array(digests, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names
        )
        least = max(FREQUENT_LEAST, int(n * FREQUENT_SHARE))
        if len(fresh_sets) < least:
            continue
        tokens = np.concatenate([sets[i] for i in fresh_sets])
        size = np.repeat(sizes[fresh_sets], sizes[fresh_sets])
        order = np.argsort(tokens)
        tokens, size = tokens[order], size[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        count = np.diff(np.append(first, len(tokens)))
        often = np.flatnonzero(count >= least)
        if len(often):
            low, high = np.minimum.reduceat(size, first)[often], np.maximum.reduceat(size, first)[often]
            k = len(often)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.array(tokens[first[often]].view(np.int64)), pa.array(count[often]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(low), pa.array(high)],
                names=names,
            )


def steps(sizes: np.ndarray) -> np.ndarray:
    """Sizes in steps of which a band has ``STEPS``: a larger size has no lower step."""
    return (np.log(sizes) / np.log(BAND) * STEPS).astype(np.int16)


def keys_of(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of one set (sorted shingles), the shingle before each single one (0: none, or a combination), and how many of the set's shingles a partner lacks at least if the key is the least of both.
    ``frequent``: the frequent class, sorted; ``rank``: its order by count."""
    n = len(tokens)
    prefix = n - needed(n) + 1
    rare, common = tokens, tokens[:0]
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = frequent[at] == tokens
        rare = tokens[~often]
        common = tokens[often][np.argsort(rank[at[often]], kind="stable")][: max(0, prefix + 1 - len(rare))]
    singles = rare[:prefix]
    i, j = np.triu_indices(len(common), 1)
    keys = np.concatenate((singles, mix(mix(common[i]) + common[j] * U(0x9E3779B97F4A7C15))))
    before = np.zeros(len(keys), U)
    before[1 : len(singles)] = singles[:-1]
    return keys, before, np.concatenate((np.arange(len(singles)), len(rare) + j - 1))


def make_keys(frequent: np.ndarray, rank: np.ndarray, buckets: int):
    """Rows (bucket, part): the keys of a batch's distinct sets, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in in_pieces(batches):
            by = {digest(s): s for s in shingle_sets(texts) if len(s)}
            if not by:
                continue
            found = [keys_of(s, frequent, rank) for s in by.values()]
            counts = [len(k) for k, _, _ in found]
            if not sum(counts):
                continue
            out = np.zeros(sum(counts), PACKED)
            out["key"], out["before"], lacks = (np.concatenate(c) for c in zip(*found, strict=True))
            out["s"] = np.repeat(np.array(list(by), np.int64), counts)
            sizes = np.repeat(np.array([len(s) for s in by.values()]), counts)
            out["size"] = steps(sizes)
            out["most"] = steps(np.minimum((100 + PERCENT) * (sizes - lacks) // PERCENT - sizes, 100 * sizes // PERCENT))
            bucket = (mix(out["key"] + SPREAD) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(first[1:], len(out))
            parts = [out[x:y].tobytes() for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(parts, pa.binary())], names=["bucket", "part"])

    return run


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by x, then y; each pair once."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[keep], y[keep]


def least_of_others(x: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the least of the other rows of its stretch, ``ABOVE`` if there is none. ``first``: starts of the stretches; ``at``: the stretch of each row."""
    least = np.minimum.reduceat(x, first)[at]
    is_least = x == least
    alone = is_least & (np.add.reduceat(is_least.astype(np.int64), first)[at] == 1)
    return np.where(alone, np.minimum.reduceat(np.where(is_least, ABOVE, x), first)[at], least)


def partnered(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """False for rows whose key can't be the least that the set shares with any other set of the group: none fits by size and place, or all share the shingle before."""
    first = stretches_of(group)[:-1]
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
    before, size, most = rows["before"], rows["size"].astype(np.int64), rows["most"].astype(np.int64)
    differ = (np.minimum.reduceat(before, first) != np.maximum.reduceat(before, first)) | (before[first] == 0)
    return differ[at] & (least_of_others(size, first, at) <= most) & (size <= -least_of_others(-most, first, at))


def leaders(t: pa.Table) -> pa.Table:
    """A bucket of keys: (leader, s), sets that share a key of a band with others, each with the least of these."""
    rows = np.frombuffer(b"".join(t.column("part").to_pylist()), PACKED)
    key = np.ascontiguousarray(rows["key"])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    rows = rows[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    band = rows["size"].astype(np.int64) // STEPS
    # sets whose sizes fit lie in one band or in neighbours
    group = np.concatenate([mix(rows["key"] + (band + k).astype(U) * SPREAD) for k in (1, 2)])
    rows = np.concatenate((rows, rows))
    order = np.lexsort((rows["s"], group))
    group, rows = group[order], rows[order]
    keep = np.ones(len(group), bool)
    keep[1:] = (group[1:] != group[:-1]) | (rows["s"][1:] != rows["s"][:-1])
    for _ in range(2):  # a set may have lost its only partner
        group, rows = group[keep], rows[keep]
        if not len(group):
            break
        keep = partnered(group, rows)
    group, s = group[keep[: len(group)]], np.ascontiguousarray(rows["s"][keep[: len(group)]])
    starts = stretches_of(group)
    count = np.diff(starts)
    several = np.repeat(count, count) > 1
    leader, s = distinct_pairs(np.repeat(s[starts[:-1]], count)[several], s[several])
    return pa.table([pa.array(leader), pa.array(s)], names=["leader", "s"])


def token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in in_pieces(batches):
        by = {digest(s): s for s in shingle_sets(texts) if len(s)}
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([s.tobytes() for s in by.values()], pa.binary())], names=["s", "tokens"])


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each shingle, by its last digits, in a map of 4 to 8 bits a shingle."""
    size = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(tokens & U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_link(x, y, nx, ny):
    """False only if the sets of these maps (or of the rows of two matrices of maps) can't link. A bit of x that y lacks is a shingle of x that y lacks; sets that link lack few of each other's."""
    a, b = (np.frombuffer(m, U) if isinstance(m, bytes) else m for m in (x, y))
    while a.shape[-1] > b.shape[-1]:  # fold the larger map: its first and second half
        a = a[..., : a.shape[-1] // 2] | a[..., a.shape[-1] // 2 :]
    while b.shape[-1] > a.shape[-1]:
        b = b[..., : b.shape[-1] // 2] | b[..., b.shape[-1] // 2 :]
    overlap = -(-PERCENT * (nx + ny) // (100 + PERCENT))
    ones = lambda m: np.bitwise_count(m).sum(-1, dtype=np.int64)
    both = ones(a & b)
    return (ones(a) - both <= nx - overlap) & (ones(b) - both <= ny - overlap)


def stretches_of(*columns: np.ndarray) -> np.ndarray:
    """Starts of the stretches of rows that are equal in these columns, and the end of all."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), len(new))


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("leader", "ascending"), ("p", "ascending"), ("q", "ascending")]).combine_chunks()


def near_nodes(t: pa.Table) -> pa.Table:
    """A unit of groups, or of pairs of their blocks: leader, p, q, s, block, n, map. Its rows that have a partner by their maps."""
    t = in_order(t)
    leader, p, q, block, n = (t.column(c).to_numpy() for c in ("leader", "p", "q", "block", "n"))
    maps = t.column("map").to_pylist()
    size = np.array([len(m) for m in maps], np.int64)
    place = np.zeros(len(maps), np.int64)
    matrix = {}
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        place[at] = np.arange(len(at))
        matrix[w] = np.frombuffer(b"".join([maps[i] for i in at]), U).reshape(len(at), w // 8)
    starts = stretches_of(leader, p, q)
    later = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(maps)) - 1  # partners of a row: those after it in its stretch
    hit = np.zeros(len(maps), bool)
    part = np.cumsum(later) // CELLS
    for k in np.unique(part).tolist():
        rows = np.flatnonzero(part == k)
        count = later[rows]
        i = np.repeat(rows, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        fits = (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & ((p[i] == q[i]) | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        code = size[i] << 32 | size[j]
        for c in np.unique(code).tolist():
            x, y = i[code == c], j[code == c]
            step = max(1, MAP_BYTES // max(c >> 32, c & 0xFFFFFFFF))
            for at in range(0, len(x), step):
                u, v = x[at : at + step], y[at : at + step]
                ok = may_link(matrix[c >> 32][place[u]], matrix[c & 0xFFFFFFFF][place[v]], n[u], n[v])
                hit[u[ok]] = True
                hit[v[ok]] = True
    return t.select(["leader", "p", "q", "s", "block"]).filter(pa.array(hit))


def shared(own: np.ndarray, what: np.ndarray, rows: int) -> np.ndarray:
    """``own``: rows, ``what``: what each has, distinct for a row. How many each two rows share: products of slices of the matrix of rows and what several have."""
    _, inverse, count = np.unique(what, return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[several]]
    order = np.argsort(column, kind="stable")
    own, column = own[several][order], column[order]
    out = np.zeros((rows, rows), np.int64)
    step = max(1, CELLS // rows)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        a = np.zeros((rows, min(step, int(column[-1]) + 1 - at)), np.float32)
        a[own[lo:hi], column[lo:hi] - at] = 1
        out += (a @ a.T).astype(np.int64)
    return out


def group_links(t: pa.Table) -> pa.Table:
    """The same rows with ``tokens``, ``copies`` and the set's ``leaders`` instead of maps. A row (s, root, links) for each that links: a set that it reaches in its group, and the documents it links
    with, those aside that belong to a lesser common leader."""
    t = in_order(t)
    leader, p, q, block, s, copies = (t.column(c).to_numpy() for c in ("leader", "p", "q", "block", "s", "copies"))
    sets = [np.frombuffer(b, U) for b in t.column("tokens").to_pylist()]
    lists = [np.asarray(x, np.int64) for x in t.column("leaders").to_pylist()]
    out: list[tuple[np.ndarray, ...]] = []
    starts = stretches_of(leader, p, q).tolist()
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        m = b - a
        n = np.array([len(x) for x in sets[a:b]], np.int64)
        common = shared(np.repeat(np.arange(m), n), np.concatenate(sets[a:b]), m)
        ok = 100 * common >= PERCENT * (n[:, None] + n - common)
        np.fill_diagonal(ok, False)
        if p[a] != q[a]:
            ok &= block[a:b, None] != block[a:b]
        if not ok.any():
            continue
        lesser = [x[x < leader[a]] for x in lists[a:b]]
        mine = ok & (shared(np.repeat(np.arange(m), [len(x) for x in lesser]), np.concatenate(lesser), m) == 0)
        root = np.full(m, -1)
        for i in range(m):
            if root[i] < 0:
                reached = np.arange(m) == i
                while reached.any():
                    root[reached] = i
                    reached = ok[reached].any(0) & (root < 0)
        some = ok.any(1)
        out.append((s[a:b][some], s[a:b][root[some]], (mine @ copies[a:b])[some]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["s", "root", "links"])


def attached(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key, which ``size`` rows have), null where there are none. Keys with more rows than ``HEAVY_LEAST`` and a ``HEAVY_MOST``th of all
    ``total`` rows are broadcast, so no task gets them all; there can't be more than ``HEAVY_MOST`` of them. The rest meets by a shuffle, in groups of that size at most."""
    heavy = F.col(size) > max(HEAVY_LEAST, total // HEAVY_MOST)
    flag = fresh(rows, "heavy")
    names = [c for c in facts.columns if c not in (key, size)]
    first = rows.join(F.broadcast(facts.filter(heavy).select(key, *names, F.lit(True).alias(flag))), key, "left")
    done = first.filter(F.col(flag) | F.col(key).isNull()).drop(flag)
    rest = first.filter(F.col(flag).isNull() & F.col(key).isNotNull()).select(*rows.columns)
    return done.unionByName(rest.join(facts.filter(~heavy).select(key, *names), key, "left"))


def compared(groups: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``groups``: leader, s: all that share a key with a leader. (s, root, links) of all that link. A large group is compared in blocks of about ``BLOCK`` sets, each pair of blocks
    apart. Bit maps tell first which sets have any partner; only these are shuffled whole."""
    parts = stored(groups.groupBy("leader").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).alias("blocks")), "group-parts")
    total = groups.count()
    rows = attached(groups, parts, "leader", "rows", total).withColumn("block", F.pmod(F.xxhash64("s"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("leader", "s", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    units = max(1, int(parts.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0) // UNIT_ROWS)
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("leader", "p", "q"), F.lit(units)))
    rows = rows.join(sets.select("s", "n", "map"), "s")
    left = rows.groupBy("unit").applyInArrow(tidied_table(near_nodes), "leader long, p long, q long, s long, block long")
    left = stored(left, "group-left")
    ends = stored(sets.select("s", "rep", "copies").join(left.select("s").distinct(), "s"), "group-ends")
    reps = ends.select(F.col("rep").alias("v")).distinct()
    reps = F.broadcast(reps) if ends.count() <= BROADCAST_NODES else reps
    chosen = docs.join(reps, docs["v"].eqNullSafe(reps["v"]), "left_semi")  # sets of null ids alone come with all null ids
    tokens = chosen.mapInArrow(tidied(token_sets), "s long, tokens binary").join(ends.select("s", "copies"), "s").dropDuplicates(["s"])
    lists = groups.groupBy("s").agg(F.collect_list("leader").alias("leaders"))
    facts = stored(tokens.join(lists, "s"), "group-sets")
    whole = left.join(facts, "s").withColumn("unit", F.pmod(F.xxhash64("leader", "p", "q"), F.lit(units)))
    out = stored(whole.groupBy("unit").applyInArrow(tidied_table(group_links), "s long, root long, links long"), "group-links")
    freed(left, facts)
    return out


def tidied_table(run):
    def one(t: pa.Table) -> pa.Table:
        out = run(t)
        tidy()
        return out

    return one


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per document: its id, ``n_shingles``, ``component_id``, ``n_links`` (the other rows whose sets link with its own, copies among them)."""
    rows = docs.select(F.col(id_col).cast("long").alias("v"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stored(rows.mapInArrow(tidied(sets_of), "kind int, v long, n long, s long, map binary, low long, high long"), "sets")

    often = found.filter("kind = 1").groupBy("v").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    often = often.filter((F.col("n") >= FREQUENT_ALL) & (F.col("high") >= SIZE_FACTOR * F.col("low")))
    top = often.orderBy(F.desc("n"), "v").limit(FREQUENT_MOST).select("v", "n").collect()
    frequent = np.array([r[0] for r in top], np.int64).view(U)
    rank = np.lexsort((frequent, np.array([r[1] for r in top], np.int64))) if len(top) else np.zeros(0, np.int64)
    rank = np.argsort(rank)
    order = np.argsort(frequent)
    frequent, rank = frequent[order], rank[order]

    sized = found.filter("kind = 0")
    total, shingles = sized.agg(F.count("*"), F.sum("n")).first()
    # a batch gives the map of a set once
    sets = sized.filter("n > 0").groupBy("s").agg(F.min("v").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("map", ignorenulls=True).alias("map"))
    sets = stored(sets, "distinct")
    buckets = max(1, (shingles or 0) * (100 - PERCENT) // 100 // BUCKET_KEYS)
    keyed = rows.mapInArrow(tidied(make_keys(frequent, rank, buckets)), "bucket int, part binary")
    groups = stored(keyed.groupBy("bucket").applyInArrow(tidied_table(leaders), "leader long, s long").distinct(), "groups")
    links = compared(groups, sets, rows)

    several = sized.filter("n > 0 and v is not null").groupBy("v").agg(F.min("s").alias("least"), F.max("s").alias("most")).filter("least <> most")
    one_id = sized.filter("n > 0").join(several, "v").select(F.col("s").alias("a"), F.col("least").alias("b"))
    comps = components(links.select(F.col("s").alias("a"), F.col("root").alias("b")).unionAll(one_id)).withColumnRenamed("v", "s")
    degree = links.groupBy("s").agg(F.sum("links").alias("links"))
    facts = sets.select("s", "rep", "copies").join(comps, "s", "left").join(degree, "s", "left")
    facts = facts.select("s", "rep", "copies", F.coalesce("comp", "s").alias("comp"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    facts = stored(facts, "facts")
    named = stored(facts.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("rows")), "named")
    facts = stored(attached(facts, named, "comp", "rows", total).select("s", "copies", "component_id", "n_links"), "whole")
    out = attached(sized.select("v", "n", "s"), facts, "s", "copies", total)
    return out.select(
        F.col("v").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("v")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each class, that with the least id, with all its columns; documents without shingles and those with null ids all stay."""
    found = stored(classes(docs.select(id_col, text), text, id_col), "classes")
    goes = stored(found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col)).distinct(), "goes")
    kept = docs.join(F.broadcast(goes) if goes.count() <= BROADCAST_NODES else goes, id_col, "left_anti")
    twice = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if not twice.limit(1).count():
        return kept
    nth = fresh(docs, "nth")  # of several rows with one id, the shortest text stays
    w = Window.partitionBy(id_col).orderBy(F.col(text).isNull(), F.length(text), F.col(text))
    return kept.withColumn(nth, F.row_number().over(w)).filter((F.col(nth) == 1) | F.col(id_col).isNull()).drop(nth)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
