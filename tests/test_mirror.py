"""The kept mirror against a plain program that makes it anew, over several batches of changes."""

import random

import pytest

from latticework.operators import graph as G
from latticework.operators import mirror as MI
from latticework.operators import scope as SC
from latticework.sources import versions
from latticework.streaming import mirror as stream

FIELDS = [c.split()[0] for c in MI.CHANGE.split(", ")]


def row(seq, kind, **x):
    return tuple({"seq": seq, "kind": kind, **x}.get(f) for f in FIELDS)


class Plain:
    """Nodes, papers, mentions and relations, changed one by one; the mirror is made anew from them."""

    def __init__(self):
        self.live, self.homes, self.ties, self.facts = set(), {}, {}, {}

    def take(self, changes):
        for c in sorted(changes, key=lambda c: c[0]):
            x = dict(zip(FIELDS, c))
            if x["kind"] == "node":
                (self.live.add if x["there"] else self.live.discard)((x["node_type"], x["node_slug"]))
            elif x["kind"] == "paper":
                self.homes.pop(x["paper_slug"], None)
                if x["there"]:
                    self.homes[x["paper_slug"]] = x["brain_id"]
            else:
                at = self.ties if x["kind"] == "mention" else self.facts
                key = tuple(x[k] for k in (MI.MENTION if x["kind"] == "mention" else ("node_type", "node_slug", "rel_type", "to_type", "to_slug")))
                at[key] = at.get(key, 0) + x["n"]

    def tables(self):
        edges, tags = {}, {}
        for (t, s, p, c), n in self.ties.items():
            if not n or (t, s) not in self.live:
                continue
            src = ("concept", c) if t == "entity" and ("concept", c) in self.live else ("paper", p) if p in self.homes else None
            if src:
                edges[(*src, t, s)] = edges.get((*src, t, s), 0) + n
            if self.homes.get(p) is not None:
                tags[t, s, self.homes[p]] = tags.get((t, s, self.homes[p]), 0) + n
        semantic = {k: n for k, n in self.facts.items() if n and k[:2] in self.live and k[3:] in self.live}
        return edges, tags, semantic


def counts(df, keys):
    return {tuple(r[k] for k in keys): r.n for r in df.collect()}


def same(v, plain):
    for name, keys, want in zip(("edges", "tags", "semantic"), (MI.EDGE, MI.TAG, MI.RELATION), plain.tables()):
        assert counts(v.table(name), keys) == want, name


def random_batch(rng, plain, seq):
    """Changes of all kinds; nothing is taken away that isn't there."""
    out, left = [], {**plain.ties}
    nodes = [("concept", f"c{i}") for i in range(3)] + [("entity", f"e{i}") for i in range(3)] + [("entity", "c1")]
    if not seq:
        out = [row(0, "node", node_type=t, node_slug=s, there=True) for t, s in nodes] + [row(0, "paper", paper_slug=f"p{i}", there=True, brain_id=f"b{i % 2}") for i in range(4)]
    for _ in range(60):
        seq += 1
        kind = rng.choice(["node", "paper", "mention", "mention", "gone", "relation"])
        t, s = rng.choice(nodes)
        if kind == "node":
            out.append(row(seq, "node", node_type=t, node_slug=s, there=rng.random() < 0.7))
        elif kind == "paper":
            there = rng.random() < 0.7
            out.append(row(seq, "paper", paper_slug=f"p{rng.randrange(4)}", there=there, brain_id=rng.choice(["b1", "b2", None])))
        elif kind == "mention":
            key = (t, s, rng.choice(["p0", "p1", "p2", "p9", None]), rng.choice(["c0", "c1", "c2", "dead", None]) if t == "entity" else None)
            out.append(row(seq, "mention", **dict(zip(MI.MENTION, key)), n=1))
            left[key] = left.get(key, 0) + 1
        elif kind == "gone" and any(left.values()):
            key = rng.choice(sorted((k for k, n in left.items() if n), key=str))
            out.append(row(seq, "mention", **dict(zip(MI.MENTION, key)), n=-1))
            left[key] -= 1
        elif kind == "relation":
            to = rng.choice(nodes)
            out.append(row(seq, "relation", node_type=t, node_slug=s, rel_type="USES", to_type=to[0], to_slug=to[1], n=1))
    return out, seq


def empty_store(spark, root, buckets=8):
    none = {t: spark.createDataFrame([], k) for t, k in MI.TABLES.items()}
    return stream.created(spark, root, none, buckets)


def test_random_changes_equal_a_mirror_made_anew(spark, tmp_path):
    root, plain, rng, seq = str(tmp_path / "store"), Plain(), random.Random(5), 0
    empty_store(spark, root)
    for number in range(3):
        changes, seq = random_batch(rng, plain, seq)
        stream.sync(spark, root, spark.createDataFrame(changes, MI.CHANGE), "w", number)
        plain.take(changes)
        assert all(len(x) >= 3 for x in plain.tables())  # the seed gives rows of each kind after every batch
        same(versions.opened(spark, root), plain)
    # a batch that runs again counts once
    assert stream.sync(spark, root, spark.createDataFrame(changes, MI.CHANGE), "w", 2) == {}
    v = versions.opened(spark, root)
    assert v.number == 4
    same(v, plain)
    # the same as the operators that make all at once
    ties = v.table("ties")
    live, homes = v.table("live"), v.table("homes")
    of = lambda t: live.filter(live.node_type == t).select("slug")
    again = MI.whole(live, homes, ties.withColumn("n", ties.n).selectExpr("*", "explode(sequence(1, n)) as i").drop("n", "i"), v.table("facts").selectExpr("*", "explode(sequence(1, n)) as i").drop("n", "i"))
    for name, keys in (("edges", MI.EDGE), ("tags", MI.TAG), ("semantic", MI.RELATION)):
        assert counts(again[name], keys) == counts(v.table(name), keys)
    mirror = G.mirror_edges(homes.selectExpr("paper_slug as slug"), of("concept").selectExpr("slug", "slug as display_label"), of("entity"), ties.filter("node_type = 'concept'"), ties.filter("node_type = 'entity'"))
    assert {tuple(r) for r in mirror.collect()} == set(counts(v.table("edges"), MI.EDGE))
    brains = {(r.node_type, r.node_slug): r.brain_ids for r in SC.node_brain_ids(ties, homes).collect()}
    got = {(r.node_type, r.slug): r.brain_ids for r in MI.brain_ids(live, v.table("tags")).collect()}
    assert got == {(r.node_type, r.slug): brains.get((r.node_type, r.slug), []) for r in live.collect()}


def test_a_move_writes_tags_only(spark, tmp_path):
    root = str(tmp_path / "store")
    nodes = spark.createDataFrame([("concept", "hub")] + [("entity", f"e{i}") for i in range(40)], "node_type string, slug string")
    homes = spark.createDataFrame([(f"p{i}", "b1") for i in range(40)], "paper_slug string, brain_id string")
    ties = [("concept", "hub", f"p{i}", None) for i in range(40)] + [("entity", f"e{i}", f"p{i}", None) for i in range(40)]
    tables = MI.whole(nodes, homes, spark.createDataFrame(ties, ", ".join(f"{c} string" for c in MI.MENTION)), spark.createDataFrame([], ", ".join(f"{c} string" for c in MI.RELATION)))
    before = stream.created(spark, root, tables, 16)
    move = [row(1, "paper", paper_slug="p3", there=True, brain_id="b2"), row(2, "paper", paper_slug="p4", there=True, brain_id="b1")]
    moved = stream.sync(spark, root, spark.createDataFrame(move, MI.CHANGE))
    # p4 is where it was: only the hub and e3 lose a tag of one brain and gain one of the other
    assert moved == {"edges": 0, "tags": 4, "semantic": 0}
    after = versions.opened(spark, root)
    for name in ("ties", "edges", "facts", "semantic", "live"):
        assert after.record["tables"].get(name) == before.record["tables"].get(name)
    new = {b for b in after.record["tables"]["tags"] if after.record["tables"]["tags"][b] != before.record["tables"]["tags"].get(b)}
    assert len(new) <= 2
    assert counts(after.table("tags").filter("node_slug in ('hub', 'e3')"), MI.TAG) == {("concept", "hub", "b1"): 39, ("concept", "hub", "b2"): 1, ("entity", "e3", "b2"): 1}


def test_odd_changes(spark, tmp_path):
    root = str(tmp_path / "store")
    empty_store(spark, root, 2)
    assert stream.sync(spark, root, spark.createDataFrame([], MI.CHANGE)) == {"edges": 0, "tags": 0, "semantic": 0}
    odd = [
        row(1, "mention", node_type="concept", node_slug="c", paper_slug="p", n=1), row(2, "mention", node_type="concept", node_slug="c", paper_slug="p", n=-1),  # comes and goes
        row(3, "mention", node_type="entity", node_slug="e", n=2), row(4, "mention", n=1), row(5, "mention", node_type="entity", node_slug="e", paper_slug="p"),  # no source, nothing at all, no number
        row(6, "node", node_type="entity", node_slug="e", there=True), row(6, "node", node_type="entity", node_slug="e", there=False), row(7, "node", node_type="entity"), row(8, "paper", there=True),
        row(9, "paper", paper_slug="p", there=True, brain_id="b"), row(None, None), row(10, "unknown", node_slug="x", n=1),
    ]
    assert stream.sync(spark, root, spark.createDataFrame(odd, MI.CHANGE)) == {"edges": 0, "tags": 0, "semantic": 0}
    v = versions.opened(spark, root)
    assert counts(v.table("ties"), MI.MENTION) == {("entity", "e", None, None): 2, (None, None, None, None): 1}
    assert [tuple(r) for r in MI.brain_ids(v.table("live"), v.table("tags")).collect()] == [("entity", "e", [])]
    with pytest.raises(Exception, match="takes away"):
        stream.sync(spark, root, spark.createDataFrame([row(1, "mention", node_type="entity", node_slug="e", n=-3)], MI.CHANGE))
    assert versions.opened(spark, root).number == v.number
