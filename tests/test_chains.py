"""Chained merges against merging one by one."""

import random

import pytest

from latticework.operators import chains as CH

NODE = "slug string, display_label string, aliases array<string>, merged_from array<string>, user_notes string, redirect_to string"
MENTION = "node_slug string, paper_slug string, ord int, title string"
MERGE = "seq int, survivor string, loser string"


def one_by_one(nodes, mentions, merges):
    n = {r[0]: list(r) for r in nodes}
    src = {s: [list(m) for m in sorted((m for m in mentions if m[0] == s), key=lambda m: m[2])] for s in n}
    for _, s, l in sorted(merges):
        a, b = n[s], n[l]
        a[2] = sorted({*(a[2] or []), b[1], *(b[2] or [])})
        a[3] = [*(a[3] or []), l, *(b[3] or [])]
        if (b[4] or "").strip():
            a[4] = (a[4] or "") + "\n\n--- merged 2024-01-02 ---\n\n" + b[4]
        b[5] = s
        has = {m[1] for m in src[s]}
        src[s] += [m for m in src.pop(l) if m[1] not in has]
    return n, {s: [(m[1], m[3]) for m in ms] for s, ms in src.items() if ms}


def test_random_forest_and_chain(spark):
    rng = random.Random(11)
    slugs = [f"n{i:02}" for i in range(24)]
    nodes = [(s, s.upper(), rng.choice([None, ["x"], [f"a{i % 5}", "y"]]), rng.choice([None, [f"old{i}"]]), rng.choice([None, "", " ", f"note {i}"]), None) for i, s in enumerate(slugs)]
    mentions = [(s, rng.choice([None, "p1", "p2", "p3", f"own{s}"]), k, f"{s}/{k}") for s in slugs for k in range(rng.randrange(4))]
    alive, merges = slugs[:20], []
    for seq in range(14):
        s, l = rng.sample(alive, 2)
        merges.append((seq, s, l))
        alive = [x for x in alive if x != l]
    merges += [(100, "n20", "n21"), (101, "n22", "n20"), (102, "n23", "n22")]  # a chain: each survivor loses next
    tree = CH.forest(spark.createDataFrame(merges, MERGE))
    want_nodes, want_sources = one_by_one(nodes, mentions, merges)
    got = {r.slug: r for r in CH.merge_nodes(spark.createDataFrame(nodes, NODE), tree, "2024-01-02T03:04:05").collect()}
    assert set(got) == set(slugs)
    losers = {l for _, _, l in merges}
    for s in slugs:
        end = s
        while want_nodes[end][5]:
            end = want_nodes[end][5]
        assert got[s].redirect_to == (end if s in losers else None)
        if s not in losers:
            assert tuple(got[s])[:5] == tuple(want_nodes[s])[:5], s
    sources = {}
    for r in sorted(CH.merge_mentions(spark.createDataFrame(mentions, MENTION), tree).collect(), key=lambda r: (r.node_slug, r.ord)):
        sources.setdefault(r.node_slug, []).append((r.paper_slug, r.title))
    assert sources == want_sources


@pytest.mark.parametrize("wrong", [[(1, "a", "a")], [(1, "a", "b"), (2, "c", "b")], [(1, "a", "b"), (2, "b", "c")], [(1, "a", "b"), (1, "b", "a")], [(1, None, "b")]])
def test_impossible_merges_are_errors(spark, wrong):
    with pytest.raises(ValueError, match="can't be made"):
        CH.forest(spark.createDataFrame(wrong, MERGE))


def test_no_merges_and_unknown_slugs(spark):
    nodes = spark.createDataFrame([("a", "A", ["z", "b"], None, None, None)], NODE)
    none = CH.forest(spark.createDataFrame([], MERGE))
    assert none.count() == 0
    assert [tuple(r) for r in CH.merge_nodes(nodes, none, "2024-01-02").collect()] == [("a", "A", ["z", "b"], None, None, None)]
    unknown = CH.forest(spark.createDataFrame([(1, "a", "ghost")], MERGE))
    assert [r.aliases for r in CH.merge_nodes(nodes, unknown, "2024-01-02").collect()] == [["z", "b"]]
