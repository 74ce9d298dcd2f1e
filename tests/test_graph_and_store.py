from latticework import schema
from latticework.operators import graph as G
from latticework.operators import scope as SC
from latticework.operators import search as SE
from latticework.operators import store as ST
from latticework.operators import tables as TB

M = "node_type string, node_slug string, paper_slug string, paper_title string, concept_slug string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def inline(spark):
    papers = spark.createDataFrame([("p1", "One", "t"), ("p2", "Two", None)], "slug string, title string, tag string")
    concepts = spark.createDataFrame([("c1", "C1"), ("c2", "C2")], "slug string, display_label string")
    entities = spark.createDataFrame([("e1", "E1"), ("e2", "E2"), ("e3", "E3")], "slug string, display_label string")
    cm = spark.createDataFrame([("c1", "p1"), ("c1", "p2"), ("c1", "p2"), ("gone", "p1"), ("c1", "nowhere")], "node_slug string, paper_slug string")
    em = spark.createDataFrame([("e1", "p1", "c1"), ("e2", "p1", "dead"), ("e2", None, "dead"), ("e1", None, "c1")], "node_slug string, paper_slug string, concept_slug string")
    return papers, concepts, entities, cm, em


def test_edges_are_a_bag_and_the_mirror_a_set(spark):
    args = inline(spark)
    e = rows(G.provenance_edges(*args), "source", "target")
    assert e == [("concept:C1", "entity:E1"), ("concept:C1", "entity:E1"), ("p1", "concept:C1"), ("p1", "entity:E2"), ("p2", "concept:C1"), ("p2", "concept:C1")]
    m = rows(G.mirror_edges(*args), "src_type", "src_slug", "dst_slug")
    assert m == [("concept", "c1", "e1"), ("paper", "p1", "c1"), ("paper", "p1", "e2"), ("paper", "p2", "c1")]


def test_focus(spark):
    papers, concepts, entities, cm, em = inline(spark)
    nodes = TB.typed(concepts, "concept").unionByName(TB.typed(entities, "entity"))
    from pyspark.sql import functions as F

    mentions = cm.select(F.lit("concept").alias("node_type"), "node_slug").union(em.select(F.lit("entity"), "node_slug"))
    gn = G.graph_nodes(papers, nodes, mentions)
    assert rows(gn.filter("orphan"), "id") == [("concept:C2",), ("entity:E3",)]
    edges = G.provenance_edges(papers, concepts, entities, cm, em)
    n, e = G.focus_subgraph(gn, edges, spark.createDataFrame([("p2",), ("absent",)], "id string"))
    assert rows(n, "id") == [("concept:C1",), ("concept:C2",), ("entity:E1",), ("entity:E3",), ("p2",)]
    assert len(rows(e, "source", "target")) == 4


def test_links_and_attachments(spark):
    notes = spark.createDataFrame([("a", "[[b]] [[b|x]] [[a]] [[zzz]] [[d.excalidraw]]"), ("b", "![i](img/x.png) ![j](y/x.png)")], "slug string, body string")
    assert rows(G.wikilink_edges(notes), "source", "target") == [("a", "a"), ("a", "b")]
    n, e = G.attachment_edges(notes.withColumnRenamed("slug", "id"))
    assert rows(n, "id") == [("attachment:b:x.png",)] and e.count() == 2


def test_link_unlink(spark):
    m = spark.createDataFrame([("concept", "c", "p1", "One", None), ("entity", "e", None, None, "c"), ("entity", "f", "p1", "One", "c"), ("entity", "f", "p2", "Two", "c")], M)
    rq = spark.createDataFrame([("concept", "c", "p3", "Three", None), ("entity", "f", "p2", "x", None)], M)
    got = rows(ST.link(m, rq).fillna(""), "node_slug", "paper_slug", "paper_title", "concept_slug")
    assert got == [("c", "p1", "One", ""), ("c", "p3", "Three", ""), ("e", "p3", "Three", "c"), ("f", "p1", "One", "c"), ("f", "p2", "Two", "")]
    cut = spark.createDataFrame([("concept", "c", "p1")], "node_type string, node_slug string, paper_slug string")
    assert rows(ST.unlink_paper(m, cut).fillna(""), "node_slug", "paper_slug") == [("e", ""), ("f", "p2")]
    only = m.filter("node_slug = 'c' or paper_slug = 'p1'")
    assert rows(ST.unlink_paper(only, cut).fillna(""), "node_slug", "paper_slug") == [("f", "")]
    left, gone = ST.remove_paper(m, spark.createDataFrame([("p1",)], "paper_slug string"))
    assert rows(gone, "node_slug", "deleted") == [("c", True), ("f", False)] and left.count() == 2


def test_relations(spark):
    key = "from_type string, from_slug string, rel_type string, to_type string, to_slug string"
    types = spark.createDataFrame(list(schema.RELATION_TYPE_SYMMETRY.items()), "rel_type string, symmetric boolean")
    r = spark.createDataFrame([("entity", "e", "RELATED", "concept", "c", "", "p2", 1), ("concept", "c", "RELATED", "entity", "e", "why", "p1", 2), ("concept", "c", "RELATED", "entity", "e", "later", "p2", 3), ("concept", "c", "USES", "entity", "e", "", "", 4)], key + ", rationale string, paper_slug string, at int")
    from pyspark.sql import functions as F

    out = {x.rel_type: x for x in ST.upsert_relations(ST.symmetric(r, types), F.col("at")).collect()}
    assert out["RELATED"].rationale == "why" and out["RELATED"].sources == ["p2", "p1"] and out["RELATED"].from_type == "concept"
    assert out["USES"].rationale == "" and out["USES"].sources == []
    ids = spark.createDataFrame([("p", "concept", "1", "c"), ("p", "concept", "2", "c"), ("p", "entity", "3", "e")], "paper_slug string, node_type string, id string, slug string")
    drawn = spark.createDataFrame([("p", "concept", "1", "concept", "2", "USES", ""), ("p", "entity", "3", "concept", "1", "RELATED", "r"), ("p", "entity", "3", "concept", "9", "USES", ""), ("p", "entity", "3", "concept", "1", "ODD", "")], "paper_slug string, from_type string, from_id string, to_type string, to_id string, type string, rationale string")
    assert rows(ST.ingest_relations(drawn, ids, types), "from_slug", "rel_type", "to_slug") == [("c", "RELATED", "e")]


def test_names(spark):
    import pytest

    from latticework.operators import resolve as R

    n = spark.createDataFrame([("concept", "a", "Alpha", ["al"], []), ("concept", "b", "Beta", [], None)], "node_type string, slug string, display_label string, aliases array<string>, categories array<string>")
    index = R.name_index(n)
    for bad in ("ALPHA", "beta"):
        with pytest.raises(ValueError):
            ST.with_alias(n, index, "concept", "a", bad)
    assert ST.with_alias(n, index, "concept", "a", "AL").filter("slug = 'a'").first().aliases == ["al"]
    assert ST.with_alias(n, index, "concept", "a", "new").filter("slug = 'a'").first().aliases == ["al", "new"]
    r = ST.renamed(n, index, "concept", "a", "al").filter("slug = 'a'").first()
    assert (r.display_label, r.aliases) == ("al", ["Alpha"])
    assert ST.with_category(n, "b", "theory", schema.CONCEPT_CATEGORIES).filter("slug = 'b'").first().categories == ["theory"]
    with pytest.raises(ValueError):
        ST.with_category(n, "b", "misc", schema.CONCEPT_CATEGORIES)


def test_folder_without_brain_hides_the_direct_one(spark):
    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "slug string")
    folders = spark.createDataFrame([("f1", None)], "id string, brain_id string")
    fp = spark.createDataFrame([("f1", "p1")], "folder_id string, paper_slug string")
    bp = spark.createDataFrame([("b1", "p1"), ("b1", "p2")], "brain_id string, paper_slug string")
    assert rows(SC.paper_brain(papers, folders, fp, bp).fillna("-"), "paper_slug", "brain_id") == [("p1", "-"), ("p2", "b1"), ("p3", "-")]
    assert rows(SC.brain_contents(papers, folders, fp, bp), "bucket", "item") == [("b1", "p2"), ("none", "f1"), ("none", "p3")]


def test_container_names(spark):
    import pytest

    f = spark.createDataFrame([("f1", "Reading", "2024")], "id string, name string, created_at string")
    for bad in (" ", " reading "):
        with pytest.raises(ValueError):
            SC.create(f, "f2", bad, "2025")
    assert SC.create(f, "f2", " New ", "2025").filter("id = 'f2'").first().name == "New"
    assert SC.rename(f, "f1", "READING").first().name == "READING"


def test_fusion_and_scope(spark):
    a = spark.createDataFrame([("concept", "x", 1), ("concept", "y", 2)], "node_type string, node_slug string, rank int")
    b = spark.createDataFrame([("concept", "y", 1), ("entity", "z", 2)], "node_type string, node_slug string, rank int")
    got = [(r.node_slug, r.score) for r in SE.fuse(a, b).orderBy("rank").collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]
    types = spark.createDataFrame([("USES", True)], "rel_type string, symmetric boolean")
    assert SE.explicit_types([" ODD ", ""], types).count() == 0 and SE.explicit_types(["USES"], types).first().type_score == 1.0


def test_second_hop_may_return_the_seed(spark):
    e = spark.createDataFrame([("concept", "a", "entity", "b", "USES"), ("concept", "a", "entity", "c", None)], "src_type string, src_slug string, dst_type string, dst_slug string, relation string")
    vec = spark.createDataFrame([("concept", "a", [1.0, 0.0]), ("entity", "b", [1.0, 1.0])], "node_type string, node_slug string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    routed = spark.createDataFrame([("USES", 1.0)], "rel_type string, type_score double")
    seeds = spark.createDataFrame([("concept", "a")], "seed_type string, seed_slug string")
    first = SE.neighbors_routed(seeds, e, routed, vec, q)
    assert [(r.node_slug, r.score, r.total) for r in first.collect()] == [("b", 0.7071, 1)]
    assert [r.node_slug for r in SE.second_hop(first, e, routed, vec, q, 1).collect()] == ["a"]
    assert SE.second_hop(first, e, routed, vec, q, 0).count() == 0
    assert SE.neighbors_all(seeds, e).count() == 2


def test_paper_leaves_its_folder_even_for_a_missing_brain(spark):
    fp = spark.createDataFrame([("f", "p"), ("f", "q")], "folder_id string, paper_slug string")
    bp = spark.createDataFrame([("b", "p")], "brain_id string, paper_slug string")
    brains = spark.createDataFrame([("b",), ("c",)], "id string")
    f, b, found = SC.set_paper_brain(fp, bp, brains, "p", "missing")
    assert rows(f, "paper_slug") == [("q",)] and rows(b, "brain_id") == [("b",)] and not found
    f, b, found = SC.set_paper_brain(fp, bp, brains, "p", "c")
    assert rows(b, "brain_id", "paper_slug") == [("c", "p")] and found
    assert SC.toggled({"a"}, {"a", "b"}) == {"a", "b"} and SC.toggled({"a", "b", "c"}, {"a", "b"}) == {"c"}


def test_search_modes(spark):
    e = spark.createDataFrame([("concept", "a", "entity", "b", "USES"), ("paper", "p", "concept", "a", None)], "src_type string, src_slug string, dst_type string, dst_slug string, relation string")
    vec = spark.createDataFrame([("concept", "a", [1.0, 0.0]), ("entity", "b", [1.0, 1.0])], "node_type string, node_slug string, embedding array<float>")
    q = spark.createDataFrame([([1.0, 0.0],)], "q array<float>")
    docs = spark.createDataFrame([("concept", "a", "state space"), ("entity", "b", "other")], "node_type string, node_slug string, text string")
    types = spark.createDataFrame([("USES", [0.5, 0.5])], "rel_type string, embedding array<float>")
    ids = spark.createDataFrame([("concept", "a", ["b1"])], "node_type string, node_slug string, brain_ids array<string>")
    got = {r.node_slug: r for r in SE.search("state", q, vec, docs, e, types).collect()}
    assert len(got["a"].neighbors) == 2 and got["a"].rank == 1
    routed = {r.node_slug: r for r in SE.search("state", q, vec, docs, e, types, mode="routed", hop2=1).collect()}
    assert [n.node_slug for n in routed["a"].neighbors] == ["b"] and [n.node_slug for n in routed["a"].second] == ["a"]
    assert SE.search("state", q, vec, docs, e, types, mode="routed", relation_types=["ODD"]).filter("neighbors is not null").count() == 0
    assert [r.node_slug for r in SE.search("state", q, vec, docs, e, types, brain="b1", brain_ids=ids).collect()] == ["a"]
    assert SE.search("state", q, vec, docs, e, types, brain="none", brain_ids=ids).count() == 0
