"""Ingest as one operation: duplicates, names that meet the store, mentions, relations; errors of containers and sections; the whole graph build."""

import pytest

from latticework.operators import graph as G
from latticework.operators import ingest as IN
from latticework.operators import resolve as R
from latticework.operators import scope as SC
from latticework.operators import search as SE
from latticework.operators import store as ST
from latticework.schema import EXTRACTION
from latticework.sources import vault


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def paper(slug, concepts, entities=(), relations=()):
    c = [{"id": i, "label": label, "categories": None, "aliases": list(a), "description": None, "note": None} for i, label, *a in concepts]
    e = [{"id": i, "label": label, "concept_id": k, "aliases": None, "description": None, "note": None} for i, label, k in entities]
    r = [{"from_id": a, "from_type": s, "to_id": b, "to_type": t, "type": k, "rationale": why} for a, s, b, t, k, why in relations]
    return (slug, slug.title(), None, None, c, e, r)


def test_two_batches_meet_in_the_store(spark):
    types = vault.relation_types(spark)
    first = spark.createDataFrame([
        paper("p1", [("c1", "Self-Attention"), ("c2", "MoE", "Mixture of Experts")], [("e1", "GPT-2", "c1"), ("e2", "Lone", "none")], [("c1", "concept", "c2", "concept", "COMPARED_TO", ""), ("c1", "concept", "c1", "concept", "USES", "self"), ("c1", "concept", "zz", "concept", "USES", "unknown")]),
        paper("p2", [("x", "self attention"), ("y", " ")], [("e", "GPT-3", "x")]),
    ], EXTRACTION)
    store = IN.ingest(first, IN.empty(spark), types, "t1")
    assert rows(store["nodes"], "node_type", "slug") == [("concept", "moe"), ("concept", "self-attention"), ("entity", "gpt-2"), ("entity", "gpt-3"), ("entity", "lone")]
    assert rows(store["relations"], "from_slug", "rel_type", "to_slug", "rationale", "sources") == [("moe", "COMPARED_TO", "self-attention", "", ["p1"])]
    second = spark.createDataFrame([
        paper("p3", [("a", "Mixture-of-Experts"), ("b", "Selfattention Layer")], [("e", "gpt 2", "a")], [("b", "concept", "a", "concept", "IS_A", "new"), ("a", "concept", "b", "concept", "COMPARED_TO", "x")]),
        paper("p4", [("a", "self  attention")], [], []),
    ], EXTRACTION)
    store = IN.ingest(second, store, types, "t2")
    nodes = {r.slug: r for r in store["nodes"].collect()}
    assert set(nodes) == {"moe", "self-attention", "gpt-2", "gpt-3", "lone", "selfattention-layer"}
    assert sorted(nodes["self-attention"].papers) == ["p1", "p2", "p4"] and sorted(nodes["moe"].papers) == ["p1", "p3"] and nodes["moe"].created_at == "t1"
    m = rows(store["mentions"], "node_slug", "paper_slug", "concept_slug")
    assert ("gpt-2", "p1", "self-attention") in m and ("gpt-2", "p3", "moe") in m and ("lone", "p1", None) in m and len(m) == len(set(m))
    assert rows(store["papers"], "slug") == [("p1",), ("p2",), ("p3",), ("p4",)]
    assert len(rows(store["relations"], "from_slug", "rel_type", "to_slug")) == 3


def test_copies_of_a_text_are_left_out(spark):
    from pyspark.sql import functions as F

    types = vault.relation_types(spark)
    e = spark.createDataFrame([paper("p1", [("c", "One")]), paper("p2", [("c", "Two")]), paper("p3", [("c", "Three")])], EXTRACTION)
    e = e.withColumn("text_hash", F.when(F.col("paper_slug") == "p3", None).otherwise("same"))
    store = IN.ingest(e, IN.empty(spark), types, "t1")
    assert rows(store["papers"], "slug") == [("p1",), ("p3",)]
    again = IN.ingest(e.filter("paper_slug = 'p2'"), store, types, "t2")
    assert rows(again["nodes"], "slug") == [("one",), ("three",)]


def test_resolver_takes_missing_times_and_only_nodes_that_are_met(spark):
    known = spark.createDataFrame([("a", "Alpha Beta", None, None, ["p0"]), ("b", "Alpha Betas", None, "2024", []), ("z", "Quite Other", ["Zed"], "2023", ["p9"])], "slug string, display_label string, aliases array<string>, created_at string, papers array<string>")
    arrivals = spark.createDataFrame([(1, "alpha-beta", None, "p1", "One", "2025")], "seq long, label string, aliases array<string>, paper_slug string, paper_title string, at string")
    nodes, found, assigned = R.resolve_all(arrivals, "concept", known)
    assert rows(assigned, "arrival", "assigned") == [("1", "a")]  # without a time is the oldest
    assert rows(found, "slug_a", "slug_b") == [("a", "b")]
    assert rows(nodes, "slug", "created_at", "papers") == [("a", None, ["p0", "p1"]), ("b", "2024", []), ("z", "2023", ["p9"])]


def test_missing_containers_and_merged_nodes_are_errors(spark):
    folders = spark.createDataFrame([("f1", "One", None)], "id string, name string, brain_id string")
    members = spark.createDataFrame([("f1", "p")], "folder_id string, paper_slug string")
    for wrong in (lambda: SC.delete_folder(folders, members, "no"), lambda: SC.set_folder_brain(folders, "no", "b"), lambda: SC.rename(folders, "no", "x"), lambda: SC.move_paper(members, "p", "no", containers=folders)):
        with pytest.raises(KeyError):
            wrong()
    nodes = spark.createDataFrame([("concept", "a", None, "old"), ("concept", "b", "a", "old")], "node_type string, slug string, redirect_to string, user_notes string")
    assert rows(ST.with_user_notes(nodes, "concept", "a", "new"), "slug", "user_notes") == [("a", "new"), ("b", "old")]
    with pytest.raises(ValueError):
        ST.with_user_notes(nodes, "concept", "b", "new")
    with pytest.raises(KeyError):
        ST.with_user_notes(nodes, "concept", "c", "new")


def test_whole_build_with_links_attachments_and_focus(spark):
    papers = spark.createDataFrame([("p1", "One", "t"), ("p2", "Two", None)], "slug string, title string, tag string")
    concepts = spark.createDataFrame([("c1", "C1")], "slug string, display_label string")
    entities = spark.createDataFrame([("e1", "E1")], "slug string, display_label string")
    cm = spark.createDataFrame([("c1", "p1")], "node_slug string, paper_slug string")
    em = spark.createDataFrame([("e1", "p1", "c1")], "node_slug string, paper_slug string, concept_slug string")
    notes = spark.createDataFrame([("p1", "[[p2]] ![[x.PNG]] ![[x.PNG]] ![](y/x.PNG) [[d.excalidraw]]"), ("p2", "none")], "slug string, body string")
    bodies = spark.createDataFrame([("concept:C1", "c1", "concept", "![](q/z.png) ![](q/z.png) ![[no.png]]")], "id string, slug string, type string, body string")
    nodes, edges = G.build(papers, concepts, entities, cm, em, notes, bodies)
    got = rows(edges, "source", "target", "type")
    assert got.count(("p1", "attachment:p1:x.PNG", "link")) == 2  # two paths of one name
    assert got.count(("concept:C1", "attachment:concept:C1:z.png", "link")) == 2 and ("p1", "p2", "link") in got and ("p1", "tag:t", "tag") in got
    owner = {r.id: (r.owner_type, r.owner_slug, r.src) for r in nodes.filter("type = 'attachment'").collect()}
    assert owner == {"attachment:p1:x.PNG": ("note", "p1", "x.PNG"), "attachment:concept:C1:z.png": ("concept", "c1", "q/z.png")}
    n, e = G.build(papers, concepts, entities, cm, em, notes, bodies, focus=spark.createDataFrame([("p2",)], "id string"))
    assert rows(n, "id") == [("attachment:p1:x.PNG",), ("p1",), ("p2",)] and ("p1", "p2", "link") in rows(e, "source", "target", "type")


def test_types_as_a_text_with_commas():
    assert SE.listed_types(" A, ,B,,") == ["A", "B"] and SE.listed_types(["A ", ""]) == ["A"] and SE.listed_types(None) == []
