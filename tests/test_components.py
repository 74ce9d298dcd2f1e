"""Kept components against recomputation, over batches of additions and removals."""

import random

from latticework.operators import components as C


def plain(nodes, edges):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {(v, find(v)) for v in nodes}


def rows(df):
    found = [tuple(r) for r in df.select("v", "comp").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_batches_equal_recomputation(spark):
    rng, nodes, edges = random.Random(3), set(range(30)), set()
    frame = lambda pairs: spark.createDataFrame(sorted(pairs), "a int, b int")
    pick = lambda n, top: {(rng.randrange(top), rng.randrange(top)) for _ in range(n)}
    edges = {tuple(sorted(e)) for e in pick(20, 30) if e[0] != e[1]}
    table = C.components(frame(edges), spark.createDataFrame([(v,) for v in nodes], "v int"))
    stored = frame(edges)
    for n_added, n_gone in ((8, 5), (0, 12), (25, 3)):
        added = pick(n_added, 40)  # loops and edges that are there already among them, and nodes that are new
        gone = {(b, a) for a, b in rng.sample(sorted(edges), min(n_gone, len(edges)))} | {(38, 39)} | set(sorted(added)[:1])
        table, stored = C.updated(table, stored, frame(added), frame(gone))
        real = {tuple(sorted(e)) for e in added if e[0] != e[1]}
        edges = (edges - {tuple(sorted(e)) for e in gone}) | real
        nodes |= {v for e in real for v in e}
        assert rows(table) == plain(nodes, edges)
        assert {tuple(r) for r in stored.collect()} == edges


def test_long_path_cut_and_closed(spark):
    path = spark.range(200).selectExpr("cast(id as int) as a", "cast(id + 1 as int) as b")
    table = C.components(path)
    one = lambda a, b: spark.createDataFrame([(a, b)], "a int, b int")
    none = path.limit(0)
    table, edges = C.updated(table, path, none, one(100, 101))
    assert {c for _, c in rows(table)} == {0, 101}
    table, edges = C.updated(table, edges, one(200, 0), none)
    assert {c for _, c in rows(table)} == {0}


def test_odd_batches(spark):
    empty = spark.createDataFrame([], "a string, b string")
    nobody = spark.createDataFrame([], "v string, comp string")
    table, edges = C.updated(nobody, empty, empty, empty)
    assert rows(table) == set() and edges.count() == 0
    odd = spark.createDataFrame([("x", "x"), (None, "y"), ("b", "a"), ("a", "b"), (None, None)], "a string, b string")
    table, edges = C.updated(nobody, empty, odd, odd)
    assert rows(table) == {("a", "a"), ("b", "a")} and [tuple(r) for r in edges.collect()] == [("a", "b")]
    table, edges = C.updated(table, edges, empty, odd)
    assert rows(table) == {("a", "a"), ("b", "b")} and edges.count() == 0
