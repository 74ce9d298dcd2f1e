import json

import pytest
from pyspark.sql import functions as F

from latticework import schema
from latticework.functions import text as T
from latticework.operators import tables as TB
from latticework.sources import vault


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_slugs(spark):
    assert one(spark, "A: study — of `x`  (v2.0)", T.slugify) == "A study of x (v2.0)"
    assert one(spark, "x" * 69 + " yz", T.slugify) == "x" * 69 and one(spark, "???", T.slugify) == "untitled" and one(spark, None, T.slugify) == "untitled"


def test_links(spark):
    body = "[[a]] [[a|b]] [[a#h]] ![[x.png]] ![alt](y.png) [[d.excalidraw]]"
    assert one(spark, body, T.wikilinks) == ["a", "x.png", "d.excalidraw"] and one(spark, body, T.md_images) == ["y.png"]
    assert one(spark, " a|b\nc ", T.table_cell) == "a\\|b c"


def test_references(spark):
    base = "\n".join(f"line {i}" for i in range(20))
    assert one(spark, f"{base}\n3. References\n[1] x", T.strip_references) == base
    assert one(spark, f"{base}\n참고 문헌\nx", T.strip_references) == base
    assert one(spark, f"References\n{base}", T.strip_references) == f"References\n{base}"
    late = "a\nb\nReferences\n" + "long line of references\n" * 9
    assert one(spark, late, T.strip_references) == late
    assert one(spark, "see references here\n" + base, T.strip_references) == "see references here\n" + base


def test_cosine_guards(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0], [1.0]), ([], []), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.c for r in d.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_vault_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    node = "---\nslug: moe\ntype: concept\ndisplay_label: MoE\naliases: [a, b]\nsources:\n- {slug: p1, title: One, concept_slug: null}\n---\n\nbody"
    for name, content in {"concept/moe.md": node, "concept/bad.md": "---\n: [\n---\nx", "note/p 1/p 1.md": "---\ntitle: ''\ntags: single\n---\nhello [[moe]]", "note/p2/other.md": "x"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    nodes = vault.read_nodes(spark, f"{tmp_path}/concept")
    assert [(r.slug, r.aliases) for r in TB.live(nodes).collect()] == [("moe", ["a", "b"])]
    assert [(r.node_slug, r.ord, r.paper_slug) for r in vault.mentions_of(nodes).collect()] == [("moe", 0, "p1")]
    notes = vault.read_notes(spark, f"{tmp_path}/note").collect()
    assert [(r.slug, r.title, r.tags, r.body) for r in notes] == [("p 1", "p 1", ["single"], "hello [[moe]]")]
    (tmp_path / "folders.json").write_text(json.dumps([{"id": "f", "name": "F", "paper_slugs": ["b", "a"], "brain_id": None, "created_at": "2024"}]))
    f = vault.read_folders(spark, f"{tmp_path}/folders.json")
    assert [(r.pos, r.paper_slug) for r in vault.members(f, "folder_id").orderBy("pos").collect()] == [(0, "b"), (1, "a")]
    assert vault.read_brains(spark, f"{tmp_path}/none.json").count() == 0
    assert vault.relation_types(spark).count() == len(schema.RELATION_TYPE_SYMMETRY) == 12


def test_render_and_attachment(spark):
    d = spark.createDataFrame([("MoE", "concept", ["x"], ["theory"], [("p1", "One"), (None, None)], "about", "note")], "label string, type string, aliases array<string>, categories array<string>, sources array<struct<slug: string, title: string>>, description string, note string")
    text = d.select(vault.render_node(*(F.col(c) for c in d.columns)).alias("t")).first().t
    assert text == "# MoE\n\n**Other names**: x\n\n**Categories**: theory\n\n**Papers**: 1\n- [[p1|One]]\n- (no paper: linked to a concept)\n\n---\n\nabout\n*note*"
    files = spark.createDataFrame([("/v/z/a.png",), ("/v/me/a.png",), ("/v/b/a.png",), ("/v/me/a.txt",)], "path string")
    assert vault.find_attachment(files, "me", "../a.png").first().path == "/v/me/a.png" and vault.find_attachment(files, "q", "a.png").first().path == "/v/b/a.png"
    assert vault.find_attachment(files, "me", "a.txt").count() == 0


def test_cost(spark):
    usage = spark.createDataFrame([("m", 1_000_000, 500_000, None, 2_000_000), ("odd", 1, 1, 1, 1)], "model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long")
    prices = spark.createDataFrame([("m", 2.0, 10.0)], "model string, input_price double, output_price double")
    assert TB.cost(usage.filter("model = 'm'"), prices).first().cost == pytest.approx(2 + 5 + 0.4)
    with pytest.raises(Exception, match="no price for model odd"):
        TB.cost(usage, prices).collect()


def test_labels_and_points(spark):
    nodes = spark.createDataFrame([("1", "Alpha", "note"), ("2", "alphabet", "tag"), ("3", "beta", "note")], "id string, label string, type string")
    assert [r.id for r in TB.label_search(nodes, " ALPHA ").collect()] == ["1", "2"] and [r.id for r in TB.label_search(nodes, "alpha", ("tag",)).collect()] == ["1"]
    points = spark.createDataFrame([("b", 0.0, 1.0), ("a", 1.0, 0.0), ("c", 9.0, 9.0)], "id string, x double, y double")
    assert TB.nearest(points, 0.0, 0.0).first().id == "a"
    assert one(spark, "a <!-- u --> b", lambda c: TB.section(c, "<!-- u -->")) == "b" and one(spark, "none", lambda c: TB.section(c, "<!-- u -->")) == ""


def test_note_header_and_folders(spark, tmp_path):
    old = "---\nt: 1\n---\n\n# T\n\n**Authors**: a\n*meta*\n#x #y\n\nbody"
    assert one(spark, old, vault.without_repeated_header) == "---\nt: 1\n---\n\n# T\n\n*meta*\n\nbody"
    assert one(spark, "# T\r\n\r\n**Authors**: a\r\n\r\nbody", vault.without_repeated_header) == "# T\r\n\r\nbody"
    assert one(spark, "# T\n\nbody", vault.without_repeated_header) == "# T\n\nbody"
    for name in ("b/x.md", "a/x.md", "_t/x.md", "top.md"):
        f = tmp_path / "vault" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    assert [r.slug for r in vault.list_papers(spark, f"{tmp_path}/vault").collect()] == ["a", "b"]


def test_rendered_note(spark):
    d = spark.sql("""select 'One | two' as title, 'short' as tldr, array('why') as motivation, array(struct('a|b' as claim, 'c' as evidence)) as claims,
      array(struct('c1' as id, 'MoE' as label, 'experts' as description, 'n' as note)) as concepts,
      array(struct('Switch' as label, 'c1' as concept_id, 'model' as description, 'x' as note), struct('Free' as label, 'zz' as concept_id, 'model' as description, 'y' as note)) as entities, 'few' as limitations""")
    text = d.select(vault.render_note(*(d[c] for c in d.columns)).alias("content")).first().content
    assert "| 1 | a\\|b | c |" in text and "| [[Switch]] | model | MoE |" in text and "| [[Free]] | model | y |" in text and text.startswith("# One | two\n\n> **TL;DR**: short")


def test_node_files_come_back(spark, tmp_path):
    from pyspark.sql import functions as F

    kind = "node_type string, slug string, label string, aliases array<string>, categories array<string>, sources array<struct<slug: string, title: string, concept_slug: string>>, description string, note string, created_at string, merged_from array<string>, redirect_to string, user string"
    rows = [
        ("concept", "a", 'Quote " and: colon', ["x, y", "[z]"], ["theory"], [("p1", "One", None)], "line\none", None, "2024", [], None, "mine\n"),
        ("entity", "b", "é 漢", [], [], [(None, None, "a"), ("p2", "Two", "a")], None, "n", None, ["old"], "a", None),
    ]
    d = spark.createDataFrame(rows, kind)
    files = d.select(F.concat("node_type", F.lit("s/"), "slug", F.lit(".md")).alias("path"), vault.node_file(*(F.col(c) for c in ("node_type", "slug", "label", "aliases", "categories", "sources", "description", "note", "created_at", "merged_from", "redirect_to", "user"))).alias("content"))
    assert sorted(r.path for r in vault.write_files(files, str(tmp_path)).collect()) == ["concepts/a.md", "entitys/b.md"]
    back = {r.slug: r for r in vault.read_nodes(spark, str(tmp_path)).collect()}
    for t, slug, label, aliases, categories, sources, description, note, at, merged, redirect, user in rows:
        r = back[slug]
        assert (r.node_type, r.display_label, r.aliases, r.description, r.note, r.created_at, r.merged_from, r.redirect_to) == (t, label, aliases, description, note, at, merged, redirect)
        assert (r.categories or []) == categories and [tuple(s) for s in r.sources] == sources and r.body.endswith(f"{vault.USER_MARKER}\n{user or ''}")
        assert TB.section(F.lit("x"), "y") is not None
    m = {tuple(x) for x in vault.mentions_of(vault.read_nodes(spark, str(tmp_path))).select("node_slug", "paper_slug", "concept_slug").collect()}
    assert m == {("a", "p1", None), ("b", None, "a"), ("b", "p2", "a")}
    summary = spark.sql("select struct(1 as cost, 'é' as t) as p").select(F.lit("s/s.summary.json").alias("path"), vault.summary_file(F.col("p")).alias("content"))
    vault.write_files(summary, f"file://{tmp_path}").collect()
    assert json.loads((tmp_path / "s" / "s.summary.json").read_text()) == {"cost": 1, "t": "é"}


def test_vocabulary_from_a_file_and_papers_by_age(spark, tmp_path):
    import os

    (tmp_path / "types.json").write_text('{\n "types": {"EATS": {"symmetric": false}, "LIKES": {"symmetric": true}, "ODD": {}}}')
    (tmp_path / "broken.json").write_text("{")
    got = {tuple(r) for r in vault.read_relation_types(spark, f"{tmp_path}/types.json").collect()}
    assert got == {("EATS", False), ("LIKES", True), ("ODD", False)}
    for name in ("broken.json", "absent.json"):
        assert vault.read_relation_types(spark, f"{tmp_path}/{name}").count() == len(schema.RELATION_TYPE_SYMMETRY)
    for i, slug in enumerate(("late", "early")):
        (tmp_path / "notes" / slug).mkdir(parents=True)
        note = tmp_path / "notes" / slug / f"{slug}.md"
        note.write_text("x")
        os.utime(note, (2_000_000_000 - i * 1000,) * 2)
    assert [r.slug for r in vault.papers_by_age(spark, f"{tmp_path}/notes").collect()] == ["early", "late"]
