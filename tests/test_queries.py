"""Every query that has SQL gives the same rows as DuckDB on the smallest data, and the entry point works."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from latticework import queries as Q
from latticework.functions.text import label_key
from latticework.operators.resolve import Resolver
from latticework.plans.views import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return "[" + ",".join(map(plain, x)) + "]" if isinstance(x, (list, tuple)) else repr(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    cur = con.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert mine == sorted(tuple(map(plain, r)) for r in cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(Q.QUERIES) <= set(entry.queries())
    assert Q.QUERIES["resolve_batch"](spark, DATA).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_resolve_batch_takes_all_parts(spark):
    got = sum(r.n_papers for r in Q.QUERIES["resolve_batch"](spark, DATA).collect())
    assert got == spark.read.parquet(f"{DATA}/part.parquet").count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_alias_canonical_against_brute_force(spark):
    parts = [(r.p_name, r.p_brand) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    labels = sorted({name for name, _ in parts})
    holds = {name: {label_key(b) for n, b in parts if n == name} for name in labels}
    root, sig = {name: name for name in labels}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in labels:
        for b in labels:
            if holds[a] & holds[b] or label_key(a) in holds[b] or Resolver.match(label_key(a), label_key(b), sig):
                root[find(a)] = find(b)
    want = {(a, min((b for b in labels if find(b) == find(a)), key=lambda x: (len(x), x))) for a in labels}
    assert {tuple(r) for r in Q.QUERIES["alias_canonical"](spark, DATA).select("label", "canonical").collect()} == want


def naive_nodes(labels):
    """One resolver that compares each name with all names before it."""
    nodes, sig = [], {}
    for seq, label in labels:
        hits = [n for n in nodes if any(Resolver.match(label_key(label), k, sig) for k in n["keys"])]
        if hits:
            first = min(hits, key=lambda n: (n["at"], n["slug"]))
            first["keys"].add(label_key(label))
            first["papers"] += 1
            if label_key(label) != label_key(first["label"]):
                first["aliases"].add(label)
        else:
            nodes.append({"slug": label_key(label).replace(" ", "-"), "label": label, "keys": {label_key(label)}, "aliases": set(), "at": seq, "papers": 1})
    return sorted((n["slug"], n["label"], "|".join(sorted(n["aliases"])), n["papers"]) for n in nodes)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_resolve_batch_against_one_resolver_over_all_rows(spark):
    rows = sorted((r.p_partkey, r.p_name) for r in spark.read.parquet(f"{DATA}/part.parquet").collect())
    got = sorted(tuple(r) for r in Q.QUERIES["resolve_batch"](spark, DATA).select("slug", "display_label", "aliases", "n_papers").collect())
    assert got == naive_nodes(rows)


def test_nothing_depends_on_the_optional_subpackage():
    root = os.path.dirname(Q.__file__)
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, n)) as f:
                    assert "llm" not in f.read(), n
