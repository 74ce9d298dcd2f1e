import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from latticework.llm import anchors, induced, similar, substrings
from latticework.llm.components import components
from latticework.llm.shingles import shingle_sets


# ---- suffix sorting ----
def test_suffix_array_and_prefixes_against_brute_force():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n, a, cap = int(rng.integers(1, 80)), int(rng.integers(1, 5)), int(rng.choice([3, 10, 200]))
        x = rng.integers(0, a, n)
        if trial % 3 == 0:
            x = np.concatenate((x, x[: n // 2], x))
        order, prefix, spilled = induced.suffix_array(x, cap, budget=int(rng.choice([5, 10**6])))
        row = x.tolist()
        assert sorted(order.tolist()) == list(range(len(row)))
        heads = [row[i : i + cap] for i in order]
        assert heads == sorted(heads)

        def common(u, v):
            k = 0
            while k < min(len(u), len(v), cap) and u[k] == v[k]:
                k += 1
            return k

        assert prefix.tolist() == [0] + [common(row[i:], row[j:]) for i, j in zip(order, order[1:], strict=False)]


def test_queue_spills_and_keeps_order():
    q = induced.Queue(budget=10)
    for i in range(50):
        q.push(i % 3, np.array([i]), np.array([i], np.int32))
    assert q.spilled and [q.pop(b)[0].tolist() for b in range(3)] == [list(range(b, 50, 3)) for b in range(3)]
    q.close()


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    common = bytes(rng.choices(b"abcdefgh ", k=180))
    docs = [bytes(rng.choices(b"abcdefgh ", k=rng.randint(0, 400))) + common + bytes(rng.choices(b"xyz", k=rng.randint(0, 300))) for _ in range(6)]
    ends = np.cumsum([len(d) for d in docs])
    blob = b"".join(docs)
    h, c, a, n = anchors.stretches(np.frombuffer(blob, np.uint8), ends)
    by = {}
    for hh, start, count in zip(h.tolist(), a.tolist(), n.tolist(), strict=True):
        for s in range(start, start + count):
            by.setdefault(blob[s : s + 100], set()).add(hh)
    assert all(len(x) == 1 for x in by.values())
    assert int(n.sum()) == sum(max(0, len(d) - 99) for d in docs)


def brute_removed(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(b[s : s + 100])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_removed_bytes_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(4)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(base)[rng.randint(0, 50) :][: rng.randint(0, 300)] for _ in range(rng.randint(0, 5)))
        rows.append((i // 2 if i % 3 else i, "ab" * rng.randint(0, 300) if i % 9 == 0 else t))
    rows += [(None, base[0]), (3, None), (4, ""), (None, None)]
    for given in (rows, [(i, t) for i, (_, t) in enumerate(rows)]):  # ids that come twice and null ids; then distinct ones
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, substrings.deduplicate(docs).collect()), key=str) == brute_removed(given)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in substrings.deduplicate(odd_docs).collect()}
    assert len(got) == len({(i, len((t or "").encode())) for i, t in odd}) and got[(5, 300_000)] == 299_999
    assert substrings.deduplicate(no_docs).count() == 0


def test_shard_with_a_repeat_at_the_very_end_of_suffix_order():
    rng = random.Random(8)
    for _ in range(60):
        window = "".join(rng.choices("wxyz", k=100))
        pieces = [(rng.choice(["", "a", "~", "zz"]) + w + rng.choice(["", "a", "~"])).encode() for w in [window] * rng.randint(2, 4) + ["".join(rng.choices("ab", k=rng.randint(100, 130))) for _ in range(3)]]
        rng.shuffle(pieces)
        seen, want = set(), set()
        for i, p in enumerate(pieces):
            for s in range(len(p) - 99):
                if p[s : s + 100] in seen:
                    want.add((i, s))
                seen.add(p[s : s + 100])
        v, a, n = substrings.shard_repeats(np.arange(len(pieces)), np.zeros(len(pieces), np.int64), pieces)
        assert {(i, s) for i, start, k in zip(v.tolist(), a.tolist(), n.tolist(), strict=True) for s in range(start, start + k)} == want


def brute_windows(cuts):
    seen, want = set(), set()
    for i, p in enumerate(cuts):
        for k in range(len(p) - 99):
            if p[k : k + 100] in seen:
                want.add((i, k))
            seen.add(p[k : k + 100])
    return want


def windows_of(v, a, n):
    return {(i, k) for i, start, m in zip(np.asarray(v).tolist(), np.asarray(a).tolist(), np.asarray(n).tolist(), strict=True) for k in range(start, start + m)}


def test_shard_many_times_its_memory_spills_and_recurses(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(induced, "BASE", 1)
    base = [bytes(rng.choices(b"abcd ", k=rng.randint(100, 400))) for _ in range(12)]
    cuts = [p for b in base for p in [b[rng.randint(0, 40) :] + bytes(rng.choices(b"xyz", k=rng.randint(0, 50))) for _ in range(5)] if len(p) >= 100]
    cuts += [b"ab" * 300, b"ab" * 120, b"a" * 500]
    for memory, many in ((64, 4096), (1000, 4096), (64, 8)):  # with 8 symbols buckets are swept in blocks
        monkeypatch.setattr(induced, "MANY", many)
        shard = substrings.Shard(memory)
        shard.add(np.arange(len(cuts)), np.zeros(len(cuts), np.int64), cuts)
        found = [windows_of(*x) for x in shard.repeats()]
        assert set().union(*found) == brute_windows(cuts)
        assert shard.text.n > 10 * memory and shard.spilled[0] > 10 * memory and shard.depth[0] > 0


def test_common_grams_keep_the_sieve_lossless_and_spread_a_hot_passage():
    rng = random.Random(10)
    letters = b"abcdefgh "
    hot = bytes(rng.choices(letters, k=160))
    docs = [bytes(rng.choices(letters, k=rng.randint(50, 300))) + hot + bytes(rng.choices(letters, k=rng.randint(50, 300))) for _ in range(100)]
    blob, ends = substrings.joined(docs)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([d.decode() for d in docs])], names=["v", "text"])
    made = pa.Table.from_batches(list(substrings.hot_grams(iter([batch]))))
    assert made.num_rows > 0
    common = anchors.Common(made.column("gram").to_numpy().view(np.uint64))
    most = {}
    for name, c in (("plain", None), ("common", common)):
        h, _, at, n = anchors.stretches(blob, ends, c)
        by = {}
        for hh, start, count in zip(h.tolist(), at.tolist(), n.tolist(), strict=True):
            for k in range(start, start + count):
                by.setdefault(bytes(blob[k : k + 100]), set()).add(hh)
        assert all(len(x) == 1 for x in by.values()) and int(n.sum()) == sum(len(d) - 99 for d in docs)
        inside = {bytes(hot[k : k + 100]) for k in range(61)}
        open_windows = np.array([sum(bytes(blob[k : k + 100]) not in inside for k in range(a, a + m)) for a, m in zip(at.tolist(), n.tolist(), strict=True)])
        values, where = np.unique(h, return_inverse=True)
        most[name] = np.bincount(where, open_windows).max()
    assert most["common"] < most["plain"] / 2  # windows that reach beyond the passage no longer meet at its anchors


def test_shards_in_tasks_hot_anchor_goes_without_the_sieve(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(substrings, "SIEVE_BYTES", 1500)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 4000)
    rows = []
    for h in range(8):
        common = bytes(rng.choices(b"abc", k=130))
        rows += [(h, len(rows) + i, 0, bytes(rng.choices(b"xy", k=rng.randint(0, 9))) + common) for i in range(60 if h == 3 else 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "v", "a", "piece"])
    found = [windows_of(*(out.column(k).to_numpy() for k in range(3))) for out in substrings.sort_shards(iter([batch.slice(0, 50), batch.slice(50)]))]
    assert len(found) > 1 and set().union(*found) == {(rows[i][1], k) for i, k in brute_windows([r[3] for r in rows])}


# ---- components ----
def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Jaccard join ----
def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]
            if same_id or (sets[a] and sets[b] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k)):
                parent[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids) if sets[a] and ids else i if not sets[a] else None))
    return sorted(out, key=str)


def test_shingle_counts():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "B", "é\n", "c\t", "\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["w" * 3_000_000 + " x y z q"]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_maps_never_rule_out_a_link():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randint(2, 400)
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        keep = [t for t in x if rng.random() < 0.93]
        y = np.unique(np.array(keep + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 10 + 1))], np.uint64))
        k = len(np.intersect1d(x, y))
        if len(y) and 100 * k >= 80 * (len(x) + len(y) - k):
            assert similar.may_link(similar.bitmap(x), similar.bitmap(y), len(x), len(y))


def near_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.randint(6, 90))
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += [" ".join(rng.choices(words, k=rng.randint(0, 25)) + passage[: rng.randint(50, 60)] + rng.choices(words, k=rng.randint(0, 150))) for _ in range(120)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_classes_against_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = near_corpus(seed)
        monkeypatch.setattr(similar, "FREQUENT_ALL", 40 if seed == 1 else 10**9)  # with and without combinations
        monkeypatch.setattr(similar, "BLOCK", 5)  # several blocks for each group
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert sorted((tuple(r)[:3] for r in similar.classes(docs).collect()), key=str) == brute_classes(rows)


def groups_of(texts, frequent, buckets):
    """The rows (leader, s) of each bucket, without Spark, and the sets by name."""
    rank = np.arange(len(frequent))
    parts = {}
    for at in range(0, len(texts), 50):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts[at : at + 50]))), pa.array(texts[at : at + 50])], names=["v", "text"])
        for out in similar.make_keys(frequent, rank, buckets)(iter([batch])):
            for bucket, part in zip(out.column("bucket").to_pylist(), out.column("part").to_pylist(), strict=True):
                parts.setdefault(bucket, []).append(part)
    rows = []
    for found in parts.values():
        made = similar.leaders(pa.table([pa.array(found, pa.binary())], names=["part"]))
        rows += zip(made.column("leader").to_pylist(), made.column("s").to_pylist(), strict=True)
    return rows, {similar.digest(s): s for s in shingle_sets(texts) if len(s)}


def test_every_link_lies_in_a_group():
    rng = random.Random(13)
    for seed in range(15):
        texts = [t for _, t in near_corpus(100 + seed)]
        for _ in range(40):  # sizes as far apart as links allow
            base = [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(5, 300))]
            texts += [" ".join(base), " ".join(base[: rng.randint(len(base) * 7 // 10, len(base))]), " ".join(base + base[:3] + [f"u{rng.randrange(10**6)}" for _ in range(len(base) // 5)])]
        every = np.unique(np.concatenate(shingle_sets(texts)))
        frequent = every[np.array([rng.random() < (0, 0.3, 0.9)[seed % 3] for _ in every], bool)]
        rows, sets = groups_of(texts, frequent, 1 + seed % 5)
        groups = {}
        for leader, s in rows:
            groups.setdefault(s, set()).add(leader)
        names, checked = sorted(sets), 0
        for i, a in enumerate(names):
            for b in names[:i]:
                x, y = len(sets[a]), len(sets[b])
                if 100 * min(x, y) >= 80 * max(x, y):
                    k = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * k >= 80 * (x + y - k):
                        checked += 1
                        assert groups.get(a, set()) & groups.get(b, set())
        assert checked > 30


def test_near_copies_meet_at_few_of_their_keys():
    """Two texts that share about eighty keys are no rows in each of many buckets."""
    rng = random.Random(14)
    texts = []
    for _ in range(50):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), " ".join([*base[:200], "x", *base[201:]])]
    few, many = (len(groups_of(texts, np.zeros(0, np.uint64), n)[0]) for n in (1, 64))
    assert few >= 100 and many <= 6 * few


def test_sets_that_cannot_meet_first_at_a_key_make_no_group():
    """The only shingle that two long texts share is so late in both that it can't be the first of many."""
    rng = np.random.default_rng(15)
    shared = np.uint64(2**63)
    sets = [np.sort(np.concatenate((rng.integers(1, 2**63, 15, np.uint64), [shared], rng.integers(2**63 + 1, 2**64, 84, np.uint64)))) for _ in range(2)]
    rows = np.zeros(0, similar.PACKED)
    for s, x in enumerate(sets):
        keys, before, lacks = similar.keys_of(x, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        assert shared in keys and lacks.tolist() == list(range(len(keys)))
        out = np.zeros(len(keys), similar.PACKED)
        out["key"], out["before"], out["s"] = keys, before, s
        out["size"], out["most"] = similar.steps(np.full(len(keys), 100)), similar.steps(np.minimum(180 * (100 - lacks) // 80 - 100, 125))
        rows = np.concatenate((rows, out))
    assert similar.leaders(pa.table([pa.array([rows.tobytes()], pa.binary())], names=["part"])).num_rows == 0


def test_near_copies_behind_an_early_superset(spark):
    """A long first document leads the keys of two near copies of a part of it, but can't link with them by its size."""
    rng = random.Random(9)
    rows = []
    for _ in range(40):
        article = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        copies = [list(article) for _ in range(2)]
        copies[0][-1], copies[1][0] = "x", "y"
        rows += [" ".join(t) for t in (article + [f"w{rng.randrange(10**6)}" for _ in range(100)], *copies)]
    rows = list(enumerate(rows))
    want = brute_classes(rows)
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((tuple(r)[:3] for r in similar.classes(docs).collect()), key=str) == want


def test_class_edges(spark, odd_docs, no_docs):
    rows = [(5, "a b c"), (3, "A  b\nC"), (7, None), (8, ""), (9, " \t"), (None, "a b c"), (None, "lonely words"), (4, "x y"), (4, "x y"), (2, "u v w"), (2, "other text"), (1, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component_id", "2 as n_shingles", "3 as v")
    assert sorted((tuple(r)[:3] for r in similar.classes(docs).collect()), key=str) == brute_classes(rows)
    kept = similar.one_of_each(docs)
    assert set(kept.columns) == set(docs.columns)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "7", "8", "9", "None", "None"]
    assert similar.classes(odd_docs).count() == 8
    assert similar.classes(no_docs).count() == 0 and similar.one_of_each(no_docs).count() == 0


def test_heavy_groups_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(similar, "HEAVY_LEAST", 5)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i // 3}" if i % 5 else None) for i in range(60)], "v long, k string")
    counts = rows.filter("k is not null").groupBy("k").count().withColumnRenamed("count", "rows")
    facts = counts.filter("k <> 'k0'").withColumn("c", counts["rows"] * 10)
    got = sorted(map(tuple, similar.attached(rows, facts, "k", "rows", 60).select("v", "k", "c").collect()))
    want = sorted(map(tuple, rows.join(facts, "k", "left").select("v", "k", "c").collect()))
    assert got == want and len(got) == 60
    docs = spark.createDataFrame([(i, "same words for all of these rows here" if i < 20 else f"row {i} has words of its own here") for i in range(40)], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in similar.classes(docs).collect()}
    assert out == {i: 0 if i < 20 else i for i in range(40)}


def test_every_link_is_counted(spark, monkeypatch):
    """Near copies that all link with each other, copies of a text, other groups and ids of several texts, some of them null: the number of links of each row against brute force."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=200)
    rows = [(i, " ".join([*base[:i], "x" * (i + 1), *base[i + 1 :]])) for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(4)] + [(1000 + i, t) for i, t in near_corpus(3)] + [(5, "a b c"), (7, "A b c"), (None, rows[1][1]), (8, None), (9, ""), (9, rows[0][1] + " more"), (1000, rows[2][1])]
    sets = [shingles(t) for _, t in rows]
    links = [sum(b != a and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)]
    want = sorted(((*c, n) for c, n in zip(brute_classes_in_order(rows), links, strict=True)), key=str)
    assert max(links) >= 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (similar.BLOCK, 5):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert sorted((tuple(r) for r in similar.classes(docs).collect()), key=str) == want


def brute_classes_in_order(rows):
    by = {}
    for i, n, c in brute_classes(rows):
        by.setdefault((i, n), []).append(c)
    return [(i, len(s), by[i, len(s)].pop()) for (i, t) in rows for s in (shingles(t),)]
