"""The vector index and the full-text index against full scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import search as SE
from latticework.operators import text_index as TI
from latticework.operators import vector_index as VI

ROWS = "node_type string, node_slug string, embedding array<float>"


def grouped_vectors(n, groups=12, dims=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    return [(("concept", "entity", "entity")[i // groups % 3], f"v{i}", (centres[i % groups] + 0.25 * r.normal(size=dims)).astype("float32").tolist()) for i in range(n)]


def plain(vectors, query, k):
    """As ``search.vector_hits`` ranks them."""

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a:
            return 0.0
        a, b = np.array(a, float), np.array(b, float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 6) if size else 0.0

    by = {}
    for kind, slug, e in vectors:
        by.setdefault(kind, []).append((-cosine(e, query), slug))
    return sorted((s, kind, slug) for kind, rows in by.items() for s, slug in sorted(rows)[:k])


@pytest.fixture(scope="module")
def vectors():
    odd = [("concept", "null", None), ("concept", "zero", [0.0] * 16), ("entity", "empty", []), ("entity", "twin", None)]
    rows = grouped_vectors(900)
    return rows + odd + [("concept", f"copy{i}", rows[0][2]) for i in range(25)]


def test_exact_way_equals_a_full_scan(spark, tmp_path, vectors):
    df = spark.createDataFrame(vectors, ROWS)
    index = VI.built(df.limit(0).unionByName(df.filter("node_slug not like 'v%5'")), f"{tmp_path}/i", cells=10, sample=300)
    index.insert(df.filter("node_slug like 'v%5'"))  # no building again
    again = VI.opened(spark, f"{tmp_path}/i")
    assert np.allclose(again.centres, index.centres) and again.rows.count() == len(vectors)
    asked = {"a": vectors[0][2], "b": vectors[7][2], "c": [float(x) for x in np.random.default_rng(5).normal(size=16)], "z": [0.0] * 16}
    q = spark.createDataFrame(list(asked.items()), "qid string, q array<float>")
    for few in (0, VI.FEW):
        got = {}
        for r in VI.search(again, q, k=7, probes=2, exact=True, few=few).collect():
            got.setdefault(r.qid, []).append((-r.score, r.node_type, r.node_slug))
        for qid, query in asked.items():
            assert [x[1:] for x in sorted(got[qid])] == [x[1:] for x in plain(vectors, query, 7)], qid


def test_few_cells_find_most_where_vectors_have_groups(spark, tmp_path):
    rows = grouped_vectors(2400)
    index = VI.built(spark.createDataFrame(rows, ROWS), f"{tmp_path}/i", cells=40)
    queries = lambda k: spark.createDataFrame([(r[1], r[2]) for r in rows[k::97]], "qid string, q array<float>")
    probes = VI.probes_for(index, queries(1))
    found = {(r.qid, r.node_slug) for r in VI.search(index, queries(0), probes=probes).collect()}
    true = {(r.qid, r.node_slug) for r in VI.search(index, queries(0), exact=True).collect()}
    assert len(found & true) >= 0.9 * len(true) and VI.share_read(index, queries(0), probes) < 0.4
    read = VI.search(index, queries(0), probes=probes)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in read


def test_empty_index_and_fewer_rows_than_asked(spark, tmp_path):
    none = spark.createDataFrame([], ROWS)
    q = spark.createDataFrame([("a", [1.0, 0.0])], "qid string, q array<float>")
    index = VI.built(none, f"{tmp_path}/e", cells=4)
    assert VI.search(index, q, exact=True).count() == 0 and VI.search(index, q).count() == 0
    index.insert(spark.createDataFrame([("c", "x", [1.0, 1.0]), ("c", "y", [1.0])], ROWS))
    assert {r.node_slug for r in VI.search(index, q, exact=True).collect()} == {"x", "y"}


def test_many_queries_meet_codes_by_matrices(spark, tmp_path):
    """Copies and rows of several node types, by all ways through a search; a pair of query and code is no SQL expression."""
    rows = grouped_vectors(1500, seed=3)
    rows += [("concept", f"same{i:03d}", rows[5][2]) for i in range(200)] + [("entity", f"same{i:03d}", rows[5][2]) for i in range(200)]
    index = VI.built(spark.createDataFrame(rows, ROWS), f"{tmp_path}/i", cells=20)
    asked = {r[1]: r[2] for r in rows[::100]} | {"same": rows[5][2], "none": None, "short": [1.0], "gap": [1.0] * 15 + [None]}
    q = spark.createDataFrame(list(asked.items()), "qid string, q array<float>")
    for probes in (1, 30):
        found = VI.search(index, q, k=6, probes=probes, exact=True)
        got = {}
        for r in found.collect():
            got.setdefault(r.qid, []).append((r.node_type, r.node_slug))
        for qid, query in asked.items():
            assert sorted(got[qid]) == sorted(p[1:] for p in plain(rows, None if qid == "gap" else query, 6)), qid
    near = VI.search(index, q, k=6, probes=3)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with(code" not in near and "CartesianProduct" not in near


def test_rows_of_other_lengths_set_no_bar(spark, tmp_path):
    """Rows without a score fill the k places of the cells that are read first; the bar is no score of fewer than k rows."""
    rows = [("entity", f"a{i}", [1.0, 0.01 * i, 0.0]) for i in range(2)] + [("entity", f"b{i}", [0.5, 1.0, 0.01 * i]) for i in range(6)] + [("entity", f"c{i}", [1.0, 2.0]) for i in range(9)]
    index = VI.built(spark.createDataFrame(rows, ROWS), f"{tmp_path}/i", cells=2)
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.0])], "qid string, q array<float>")
    got = {r.node_slug for r in VI.search(index, q, k=5, probes=1, exact=True).collect()}
    assert got == {"a0", "a1", "b0", "b1", "b2"}


# ---- full text ----
def made_docs(n, seed=2):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(40)], k=r.randint(0, 60))) + (" Zebra!" if i % 50 == 7 else "")) for i in range(n)] + [(n, None), (n + 1, "")]


ASKED = ["w0 w1", "zebra w3", "w39 w38 w37 zebra", "ZEBRA", "nothing here", "?!", "w5 w5"]


def test_text_index_equals_a_full_scan(spark, tmp_path):
    docs = spark.createDataFrame(made_docs(1200), "id long, text string")
    index = TI.built(docs.filter("id % 4 < 2"), str(tmp_path), span=16, buckets=8)
    index = index.insert(docs.filter("id % 4 = 2")).insert(docs.filter("id % 4 = 3"))
    assert len(TI.opened(spark, str(tmp_path)).state["segments"]) == 3
    for i, state in enumerate((index, index.merged())):
        for query in ASKED if i == 0 else ASKED[:3]:
            want = [(r.id, pytest.approx(r.score, abs=2e-6)) for r in SE.bm25(docs, query, 5).orderBy("rank").collect()]
            got = [(r.id, r.score) for r in TI.search(state, query, 5, first=2).orderBy("rank").collect()]
            assert got == want, query
    assert len(TI.opened(spark, str(tmp_path)).state["segments"]) == 1


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path):
    docs = [(i, "common " * (1 + i % 3) + "word " * (i % 7) + ("rare rare rare" if i in (5, 900) else "")) for i in range(3000)]
    index = TI.built(spark.createDataFrame(docs, "id long, text string"), str(tmp_path), span=32, buckets=8)
    read, mine, every = TI.share_read(index, "rare common", k=2, first=2)
    assert read < mine / 5 and mine < every
    scan = index.blocks(["rare"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan  # the folder of the term alone
    assert "p:array" not in index.blocks(["rare"]).select("term", "n")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_a_word_of_every_document_makes_small_blocks(spark, tmp_path):
    index = TI.built(spark.range(4000).select(F.col("id"), F.lit("same words").alias("text")), str(tmp_path), span=100, buckets=4)
    assert index.blocks(["same"]).agg(F.max("n")).first()[0] < 200


def test_queries_without_words_find_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert SE.bm25(docs, "?!").count() == 0 and SE.bm25(docs, "", None).columns == ["id", "score"]
