import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.functions import minhash as M
from latticework.functions import text as T
from latticework.operators import resolve as R


@pytest.mark.parametrize(
    "a, b",
    [("Self-Attention", "self  attention"), ("Mamba2", "mamba-2"), ("ＲｅｓＮｅｔ５０", "resnet 50"), ("Straße", "STRASSE"), ("é", "é"), ("!!!", "???")],
)
def test_same_key(a, b):
    assert T.label_key(a) == T.label_key(b)


def test_underscore_stays():
    assert T.label_key("a_b") == "a_b" != T.label_key("a b")


def test_native_key_equals_exact_key_on_ascii(spark):
    rng = random.Random(1)
    labels = ["".join(rng.choice("aZ09 _-.") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    d = spark.createDataFrame([(x,) for x in labels], "label string").select("label", T.normalize_ascii(F.col("label")).alias("a"), T.normalize_label(F.col("label")).alias("b"))
    assert all(r.a == r.b == T.label_key(r.label) for r in d.collect())


def test_signature_equals_big_integers():
    perms = M.permutations()
    for key in ("self attention", "ab", "x", "résumé 7"):
        grams = {key[i : i + 3] for i in range(len(key) - 2)} or {key}
        want = [min((a * zlib.crc32(g.encode()) + b) % M.PRIME for g in grams) for a, b in perms]
        assert M.signature_rows([key])[0] == want
    assert M.signature_rows([""])[0] == [0] * 64 and M.signature_rows([None]) == [None]
    big = np.array([M.PRIME - 1, 1 << 60, 12345], np.uint64)
    assert [int(x) for x in M.mul_mod(big, np.array([(1 << 32) - 1] * 3, np.uint64))] == [int(a) * ((1 << 32) - 1) % M.PRIME for a in big]


def canonical(spark, labels, aliases=None):
    rows = [(x, (aliases or {}).get(x)) for x in labels]
    d = spark.createDataFrame(rows, "label string, aliases array<string>")
    return {r.label: r.canonical for r in R.canonical_labels(d).collect()}


def test_near_duplicates_merge_and_others_stay(spark):
    c = canonical(spark, ["Self-Attention", "self attention", "Self Attention Mechanism", "Byte Pair Encoding"])
    assert c["Self-Attention"] == c["self attention"] == "Self-Attention"
    assert c["Self Attention Mechanism"] == "Self Attention Mechanism" and c["Byte Pair Encoding"] == "Byte Pair Encoding"


def test_aliases_merge(spark):
    c = canonical(spark, ["Self-Attention", "Scaled Dot Product", "Other"], {"Self-Attention": ["SA"], "Scaled Dot Product": ["sa", "x"]})
    assert c["Scaled Dot Product"] == "Self-Attention" and c["Other"] == "Other"
    assert canonical(spark, ["SA", "Self-Attention"], {"Self-Attention": ["SA"]})["Self-Attention"] == "SA"


def test_numbers_keep_apart_and_suffixes_join(spark):
    c = canonical(spark, ["ResNet-50", "ResNet-101", "GPT-2", "GPT-3", "MLA", "MLAs", "GQA", "MQA"])
    assert len({c[x] for x in ("ResNet-50", "ResNet-101", "GPT-2", "GPT-3", "GQA", "MQA")}) == 6
    assert c["MLAs"] == "MLA"


def test_empty_and_single(spark):
    assert canonical(spark, []) == {} and canonical(spark, ["Attention"]) == {"Attention": "Attention"}


def test_blocking_finds_every_pair(spark):
    rng = random.Random(7)
    words = ["selective state space model", "byte pair encoding", "mixture of experts layer", "low rank adaptation"]
    labels = set()
    for w in words:
        for _ in range(25):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice("abcdefg 12")
            labels.add("".join(x) + rng.choice(["", "s", " 2"]))
    keys = sorted({T.label_key(x) for x in labels})
    sig = dict(zip(keys, M.signature_rows(keys), strict=True))
    want = {(a, b) for a in keys for b in keys if a < b and R.Resolver.match(a, b, sig)}
    got = {tuple(r) for r in R.match_pairs(R.signed(spark.createDataFrame([(x,) for x in labels], "label string"))).collect()}
    assert got == want and len(want) > 20


def arrivals(spark, rows):
    return spark.createDataFrame([(i, label, aliases, f"p{i}", None, f"2024-01-{i:02d}") for i, (label, aliases) in enumerate(rows, 1)], "seq int, label string, aliases array<string>, paper_slug string, paper_title string, at string")


def test_bridge_becomes_one_candidate(spark):
    nodes, queue = R.resolve_batch(spark, arrivals(spark, [("MoE", []), ("Mixture-of-Experts Layer", []), ("MoE", ["Mixture-of-Experts Layer"])]), "concept")
    n = {r.slug: r for r in nodes.collect()}
    assert set(n) == {"moe", "mixture-of-experts-layer"} and n["moe"].papers == ["p1", "p3"]
    q = queue.collect()
    assert len(q) == 1 and {q[0].slug_a, q[0].slug_b} == set(n)


def test_label_is_frozen_and_aliases_sorted(spark):
    nodes, _ = R.resolve_batch(spark, arrivals(spark, [("Selective State Space Model", []), ("Selective State Space Models", ["z", "b"])]), "concept")
    r = nodes.first()
    assert nodes.count() == 1 and r.display_label == "Selective State Space Model" and r.aliases == ["Selective State Space Models", "b", "z"]


def brute_resolve(rows):
    """Each arrival against every node made before it."""
    nodes, queue, sig = {}, {}, {}
    for i, (label, aliases) in enumerate(rows, 1):
        keys = {T.label_key(x) for x in [label, *aliases]}
        hits = [n for _, n in sorted(nodes.items()) if any(R.Resolver.match(k, o, sig) for k in keys for o in n["keys"])]
        if not hits:
            slug = T.label_key(label).replace(" ", "-")
            nodes[slug] = {"slug": slug, "label": label, "aliases": list(aliases), "at": f"2024-01-{i:02d}", "papers": [f"p{i}"], "keys": set(keys)}
            continue
        first = min(hits, key=lambda n: (n["at"], n["slug"]))
        extra = [label] if T.label_key(label) != T.label_key(first["label"]) else []
        first["aliases"] = sorted({*first["aliases"], *aliases, *extra})
        first["keys"] |= keys
        first["papers"].append(f"p{i}")
        for n in hits:
            if n is not first:
                queue.setdefault(frozenset((first["slug"], n["slug"])), (first["slug"], n["slug"], label, f"p{i}"))
    return sorted((n["slug"], n["label"], n["aliases"], n["papers"]) for n in nodes.values()), sorted(queue.values())


def test_resolver_against_brute_force(spark):
    rng = random.Random(3)
    words = ["selective state space model", "byte pair encoding", "mixture of experts layer", "low rank adaptation", "moe", "ssm 2"]

    def name():
        x = list(rng.choice(words))
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = rng.choice("abc 12")
        return "".join(x) + rng.choice(["", "s", " 2"])

    rows = [(name(), [name() for _ in range(rng.choice([0, 0, 0, 1, 2]))]) for _ in range(80)]
    nodes, queue = R.resolve_batch(spark, arrivals(spark, rows), "concept")
    want_nodes, want_queue = brute_resolve(rows)
    assert sorted((r.slug, r.display_label, r.aliases, r.papers) for r in nodes.collect()) == want_nodes
    assert sorted((r.slug_a, r.slug_b, r.via_alias, r.detected_in_paper) for r in queue.collect()) == want_queue and len(want_queue) > 3


def test_fuzzy_lookup_cascade(spark):
    nodes = spark.createDataFrame([(f"f{i}", f"filler {i}", []) for i in range(20)] + [("t", "Target Concept Name", ["TCN"])], "slug string, display_label string, aliases array<string>")
    probes = spark.createDataFrame([("target-concept name",), ("tcn",), ("Target Concept Names",), ("unknown",)], "name string")
    got = {r.name: r.slug for r in R.fuzzy_lookup(probes, nodes).collect()}
    assert got == {"target-concept name": "t", "tcn": "t", "Target Concept Names": "t", "unknown": None}


def test_candidates_are_sticky(spark):
    found = spark.createDataFrame([("concept", "a", "b"), ("concept", "b", "a"), ("concept", "c", "d")], "type string, slug_a string, slug_b string")
    queue = spark.createDataFrame([("concept", "d", "c", "pending", None, None)], "type string, slug_a string, slug_b string, status string, rejected_at string, merged_at string")
    queue = R.decide(queue, "concept", "c", "d", "rejected", "now")
    assert queue.first().status == "rejected" and queue.first().rejected_at == "now"
    assert [(r.slug_a, r.slug_b) for r in R.new_candidates(found, queue).collect()] in ([("a", "b")], [("b", "a")])


def test_merge(spark):
    merges = spark.createDataFrame([("moe", "mix")], "survivor string, loser string")
    cols = "node_type string, node_slug string, ord int, paper_slug string, paper_title string, concept_slug string"
    m = spark.createDataFrame([("concept", "moe", 0, "p1", None, None), ("concept", "moe", 1, None, None, None), ("concept", "mix", 0, "p1", None, None), ("concept", "mix", 1, "p2", None, None), ("concept", "mix", 2, None, None, None)], cols)
    assert sorted((r.node_slug, r.paper_slug or "") for r in R.merge_sources(m, merges).collect()) == [("moe", ""), ("moe", "p1"), ("moe", "p2")]
    nodes = spark.createDataFrame([("moe", "MoE", ["x"], None, "mine", None), ("mix", "Mixture", ["m"], ["old"], "theirs", None)], "slug string, display_label string, aliases array<string>, merged_from array<string>, user_notes string, redirect_to string")
    out = {r.slug: r for r in R.merge_nodes(nodes, merges, "2024-01-02T00:00:00").collect()}
    assert out["moe"].aliases == ["Mixture", "m", "x"] and out["moe"].merged_from == ["mix", "old"] and "theirs" in out["moe"].user_notes
    assert out["mix"].redirect_to == "moe" and out["moe"].redirect_to is None


def test_lookups_broadcast_no_blocks(spark):
    """Spark takes blocks and signatures for much smaller than they are: a side that it broadcast had gigabytes (F1)."""
    keys = spark.range(300).selectExpr("concat('name ', id) as key").withColumn("sig", M.signature(F.col("key")))
    links = R.resolve_links(keys.select(F.col("key").alias("name")), *(spark.createDataFrame([(f"{t}1", f"Name {t}")], "slug string, display_label string") for t in "789"))
    for df in (R.match_pairs(keys), R.match_two_sides(keys, keys), links):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == [("name 8", "concept", "81"), ("name 9", "entity", "91")]


def test_labels_with_long_numbers_meet(spark):
    labels = ["part 10234 red", "parts 10234 red", "part 10234 reds", "part 10235 red", "10234", "10234s", "part 10234 7 red", "part 1023 red"]
    key = [T.label_key(x) for x in labels]
    got = {tuple(r) for r in R.match_pairs(R.signed(spark.createDataFrame([(x,) for x in labels], "label string"))).collect()}
    assert got == {(a, b) for a in key for b in key if a < b and R.Resolver.match(a, b, {})}
    assert ("part 10234 red", "part 10234 reds") in got
    rows = spark.createDataFrame([(k,) for k in key[:1]], "key string").withColumn("sig", M.signature(F.col("key")))
    assert rows.select(F.size(M.band_keys(F.col("key"), F.col("sig")))).first()[0] == len(M.band_rows(key[0], M.signature_rows(key[:1])[0])) == 1
