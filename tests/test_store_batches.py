"""Several batches against a store kept by a plain program, the versions of a store, and the stream."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_ingest import paper, rows

from latticework.functions.text import label_key
from latticework.operators import ingest as IN
from latticework.operators import resolve as R
from latticework.operators import scope as SC
from latticework.operators import store as ST
from latticework.schema import EXTRACTION, RELATION_TYPE_SYMMETRY
from latticework.sources import vault, versions
from latticework.streaming import ingest as stream


class PlainStore:
    """The store, one paper after the other."""

    def __init__(self):
        self.papers, self.nodes, self.mentions, self.relations, self.candidates, self.signatures = {}, {}, {}, {}, {}, {}

    def node(self, kind, x, paper, at):
        keys = {label_key(n) for n in [x["label"], *(x["aliases"] or [])]}
        hits = [n for (k, _), n in self.nodes.items() if k == kind and any(R.Resolver.match(a, b, self.signatures) for a in keys for b in map(label_key, [n["label"], *n["aliases"]]))]
        if not hits:
            base = slug = label_key(x["label"]).replace(" ", "-")
            i = 2
            while (kind, slug) in self.nodes:
                slug, i = f"{base}-{i}", i + 1
            self.nodes[kind, slug] = {"slug": slug, "label": x["label"], "aliases": list(x["aliases"] or []), "at": at, "papers": [paper], "note": x["note"]}
            return slug
        first = min(hits, key=lambda n: (n["at"], n["slug"]))
        first["aliases"] = sorted({*first["aliases"], *(x["aliases"] or []), *([x["label"]] if label_key(x["label"]) != label_key(first["label"]) else [])})
        if paper not in first["papers"]:
            first["papers"].append(paper)
        for other in hits:
            if other is not first:
                self.candidates.setdefault((kind, frozenset((first["slug"], other["slug"]))), (x["label"], paper))
        return first["slug"]

    def batch(self, papers, at):
        fresh, seen = [], set()
        for p, text in sorted(papers):
            owners = [s for s, t in self.papers.items() if t == text and text is not None]
            if text is None or (text not in seen and (not owners or p[0] in owners)):
                fresh.append((p, text))
            seen.add(text)
        for p, _ in fresh:
            if p[0] in self.papers:
                touched = {k[:2] for k in self.mentions if k[2] == p[0]}
                self.mentions = {k: v for k, v in self.mentions.items() if k[2] != p[0]}
                for k in touched:
                    if any(m[:2] == k for m in self.mentions):
                        self.nodes[k]["papers"] = [x for x in self.nodes[k]["papers"] if x != p[0]]
                    else:
                        del self.nodes[k]
        for p, text in fresh:
            slug, ids = p[0], {}
            self.papers[slug] = text
            for kind, column in (("concept", p[4]), ("entity", p[5])):
                for x in column:
                    if not (x["label"] or "").strip():
                        continue
                    ids[kind, x["id"]] = s = self.node(kind, x, slug, at)
                    self.mentions[kind, s, slug] = ids.get(("concept", x["concept_id"])) if kind == "entity" else None
            for x in p[6]:
                a, b = (x["from_type"], ids.get((x["from_type"], x["from_id"]))), (x["to_type"], ids.get((x["to_type"], x["to_id"])))
                if x["type"] not in RELATION_TYPE_SYMMETRY or None in (a[1], b[1]) or a == b:
                    continue
                if RELATION_TYPE_SYMMETRY[x["type"]] and a > b:
                    a, b = b, a
                r = self.relations.setdefault((*a, x["type"], *b), ["", []])
                r[0] = r[0] or x["rationale"]
                r[1] += [slug] if slug not in r[1] else []

    def state(self):
        return {
            "papers": sorted((k, str(v)) for k, v in self.papers.items()),
            "nodes": sorted((k, s, n["label"], sorted(n["aliases"]), n["at"], sorted(n["papers"]), str(n["note"])) for (k, s), n in self.nodes.items()),
            "mentions": sorted((*k, str(v)) for k, v in self.mentions.items()),
            "relations": sorted((*k, *v) for k, v in self.relations.items()),
            "candidates": sorted((k, sorted(p), *v) for (k, p), v in self.candidates.items()),
        }


def state(store):
    get = lambda t: store[t].collect()
    return {
        "papers": sorted((r.slug, str(r.text_hash)) for r in get("papers")),
        "nodes": sorted((r.node_type, r.slug, r.display_label, sorted(r.aliases or []), r.created_at, sorted(r.papers), str(r.note)) for r in get("nodes")),
        "mentions": sorted((r.node_type, r.node_slug, r.paper_slug, str(r.concept_slug)) for r in get("mentions")),
        "relations": sorted((r.from_type, r.from_slug, r.rel_type, r.to_type, r.to_slug, r.rationale, r.sources) for r in get("relations")),
        "candidates": sorted((r.type, sorted((r.slug_a, r.slug_b)), r.via_alias, r.detected_in_paper) for r in get("candidates")),
    }


WORDS = "attention mixer graph kernel sparse dense decoder prior".split()


def made_paper(r, number):
    label = lambda: " ".join(r.sample(WORDS, r.randint(1, 2))) + r.choice(["", "", "s", " 2", "-Net"])
    concepts = [(f"c{i}", label(), *([label()] if r.random() < 0.3 else [])) for i in range(r.randint(1, 3))] + [("c0", "  ")]
    entities = [(f"e{i}", label().upper(), r.choice(["c0", "c1", "zz"])) for i in range(r.randint(0, 2))]
    ends = [("concept", "c0"), ("concept", "c1"), ("entity", "e0"), ("entity", "e1")]
    relations = [(a[1], a[0], b[1], b[0], r.choice(["USES", "RELATED", "COMPARED_TO", "NONSENSE"]), r.choice(["", f"why {number}"])) for a, b in (r.sample(ends, 2) for _ in range(r.randint(0, 3)))]
    p = paper(f"p{number:02}", concepts, entities, relations)
    for x in p[4] + p[5]:
        x["note"] = f"note of {p[0]}"
    return p


def test_batches_equal_a_plain_store(spark):
    r, plain, store, types = random.Random(11), PlainStore(), IN.empty(spark), vault.relation_types(spark)
    for b, size in enumerate((8, 7, 7)):
        numbers = r.sample(range(b * 5, b * 5 + 12), size)  # some come again
        papers = [(made_paper(r, n), r.choice([None, f"text {n}", "text of several"])) for n in numbers]
        plain.batch(papers, f"t{b}")
        df = spark.createDataFrame([(*p, t) for p, t in papers], stream.ARRIVING)
        store = {t: IN.cut(df) for t, df in IN.ingest(df, store, types, f"t{b}").items()}
        got, want = state(store), plain.state()
        for table in want:
            assert got[table] == want[table], (b, table)
    assert plain.candidates and len(plain.papers) > 10


def seeded(spark):
    """A store with all that a batch must leave alone."""
    tables = IN.empty(spark)
    one = lambda t, *r: spark.createDataFrame(list(r), IN.TABLES[t])
    node = lambda kind, slug, label, to=None, papers=(): (kind, slug, label, [], "t0", list(papers), None, None, None, to)
    tables["nodes"] = one("nodes", node("concept", "foo", "bar baz", papers=["o1"]), node("concept", "gone", None, "foo"), node("concept", "alpha", "Alpha Unit", papers=["o9"]), node("entity", "lone", "Lone"), node("concept", "x", "X ray"), node("concept", "y", "Y axis"))
    tables["papers"] = one("papers", ("o1", "One", None), ("o9", "Nine", "h9"))
    tables["mentions"] = one("mentions", ("concept", "foo", "o1", "One", None), ("concept", "alpha", "o9", "Nine", None), ("entity", "lone", None, None, "foo"))
    tables["relations"] = one("relations", ("concept", "foo", "USES", "entity", "lone", "by hand", []), ("concept", "x", "RELATED", "concept", "y", "", ["o9", "o1"]))
    tables["candidates"] = one("candidates", ("concept", "y", "x", "X ray", "o1", "t0", "rejected", "t0", None))
    return tables


def second(spark):
    return spark.createDataFrame(
        [
            (*paper("o9", [("c", "Gamma"), ("g", "Gone"), ("f", "foo")]), "h9"),
            (*paper("n1", [("c", "bar-baz"), ("d", "X ray", "Y axis")], [("e", "new thing", "c")], [("c", "concept", "d", "concept", "RELATED", "drawn")]), None),
            (*paper("n2", [("c", "copy")]), "h9"),
        ],
        stream.ARRIVING,
    )


def check_second(store):
    assert rows(store["relations"], "from_slug", "rel_type", "to_slug", "sources") == [("foo", "RELATED", "x", ["n1"]), ("foo", "USES", "lone", []), ("x", "RELATED", "y", ["o9", "o1"])]
    assert rows(store["candidates"], "slug_a", "slug_b", "status") == [("y", "x", "rejected")]  # a rejected pair isn't recorded again
    assert rows(store["papers"], "slug") == [("n1",), ("o1",), ("o9",)]  # o9 is replaced, n2 is a copy of it
    live = store["nodes"].filter("redirect_to is null")
    # alpha went with its only paper; foo and gone are taken by a renamed node and a redirect
    assert rows(live, "node_type", "slug") == [("concept", "foo"), ("concept", "foo-2"), ("concept", "gamma"), ("concept", "gone-2"), ("concept", "x"), ("concept", "y"), ("entity", "lone"), ("entity", "new-thing")]
    m = rows(store["mentions"], "node_slug", "paper_slug", "concept_slug")
    assert ("lone", "n1", "foo") in m and ("new-thing", "n1", "foo") in m and ("foo-2", "o9", None) in m and not any(x[0] == "alpha" for x in m) and len(m) == len(set(m))


def test_what_a_batch_leaves_alone(spark):
    check_second(IN.ingest(second(spark), seeded(spark), vault.relation_types(spark), "t1"))


def test_versions_in_buckets_give_the_same(spark, tmp_path):
    types, root = vault.relation_types(spark), str(tmp_path)
    v = versions.created(spark, root, seeded(spark), buckets=8)
    stale = versions.opened(spark, root)
    after, gains = IN.changed(second(spark), v, types, "t1")
    new = v.commit(after, gains, "w", 0)
    check_second({t: new.table(t) for t in IN.TABLES})
    assert versions.latest(spark, root) == 2 and versions.opened(spark, root).record["writers"] == {"w": 0}
    # a reader of the old version still sees all of it, and a second writer is told
    assert rows(versions.opened(spark, root, 1).table("papers"), "slug") == [("o1",), ("o9",)]
    stale.rows("papers", spark.createDataFrame([("o1",)], "k string"))
    with pytest.raises(versions.Conflict):
        stale.commit({"papers": stale.table("papers").limit(0)}, {})
    # a writer that stops between two tables leaves the last version
    torn = versions.opened(spark, root)
    torn.rows("papers", *[spark.createDataFrame([("o1",), ("n1",), ("o9",)], "k string")])
    torn.write("papers", torn.table("papers").limit(0))
    check_second({t: versions.opened(spark, root).table(t) for t in IN.TABLES})
    with pytest.raises(ValueError):
        versions.opened(spark, root).commit({"papers": spark.createDataFrame([("zz", "t", None)], IN.TABLES["papers"])}, {})
    assert versions.expire(spark, root, keep=1) > 0
    check_second({t: versions.opened(spark, root).table(t) for t in IN.TABLES})


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    tables = IN.empty(spark)
    tables["papers"] = spark.range(2000).select(F.concat(F.lit("p"), "id").alias("slug"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("text_hash"))
    v = versions.created(spark, str(tmp_path), tables, buckets=64)
    got = v.rows("papers", spark.createDataFrame([("p7",), ("p8",), ("new",)], "k string"))
    assert len(v.touched["papers"]) <= 3 and 2 <= got.count() < 200
    assert {"p7", "p8"} <= {r.slug for r in got.collect()}


def test_indexes_are_merged_after_many_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "PARTS", 2)
    v = versions.created(spark, str(tmp_path), IN.empty(spark), buckets=2)
    for i in range(4):
        v = v.commit({}, {"hashes": spark.createDataFrame([(f"h{i}", f"p{i}"), ("h", "p")], IN.INDEXES["hashes"])})
    assert max(map(len, v.record["tables"]["hashes"].values())) <= 2
    assert rows(v.table("hashes").distinct(), "text_hash", "slug") == sorted([("h", "p"), *((f"h{i}", f"p{i}") for i in range(4))])


def test_stream_equals_batches_and_takes_each_once(spark, tmp_path):
    types, root = vault.relation_types(spark), str(tmp_path)
    inbox, store, state_dir = f"{root}/in", f"{root}/store", f"{root}/state"
    versions.created(spark, store, seeded(spark), buckets=8)
    (tmp_path / "in").mkdir()
    plain, want = seeded(spark), None
    r = random.Random(3)
    batches = [second(spark), spark.createDataFrame([(*made_paper(r, n), None) for n in (1, 2)] + [(*paper("o1", [("c", "bar bazs")]), None)], stream.ARRIVING)]
    for i, df in enumerate(batches):
        plain = {t: IN.cut(x) for t, x in IN.ingest(df, plain, types, f"batch {i:09}").items()}
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(x[0] for x in df.select(F.to_json(F.struct("*"))).collect()))
        stream.start(spark, inbox, store, state_dir, files_per_batch=1).awaitTermination()
    v = versions.opened(spark, store)
    assert v.number == 3 and v.record["writers"] == {state_dir: 1}
    want = state({**plain, "nodes": plain["nodes"].filter("redirect_to is null")})
    got = state({t: v.table(t) if t != "nodes" else v.table(t).filter("redirect_to is null") for t in IN.TABLES})
    assert got == want
    # a crash after the version and before the stream's own commit: the batch runs again and is known
    last = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    stream.start(spark, inbox, store, state_dir, files_per_batch=1).awaitTermination()
    assert versions.latest(spark, store) == 3 and state({t: versions.opened(spark, store).table(t) if t != "nodes" else v.table(t).filter("redirect_to is null") for t in IN.TABLES}) == want


def test_hub_links_are_joined_by_all_their_keys(spark):
    """Many mentions and many requests of one node: rows of the joins stay linear."""
    n = 3000
    mentions = spark.range(n).select(F.lit("entity").alias("node_type"), F.lit("hub").alias("node_slug"), F.concat(F.lit("p"), "id").alias("paper_slug"), F.lit("t").alias("paper_title"), F.lit("c").alias("concept_slug"))
    requests = spark.range(n // 2, n + n // 2).select(F.lit("entity").alias("node_type"), F.lit("hub").alias("node_slug"), F.concat(F.lit("p"), "id").alias("paper_slug"), F.lit("t").alias("paper_title"), F.lit("d").alias("concept_slug"))
    bare = spark.createDataFrame([("entity", "hub", None, None, "c"), ("entity", "hub", None, None, "c"), ("entity", "hub", None, None, None)], IN.TABLES["mentions"])
    got = ST.link(mentions.unionByName(bare.limit(1)), requests.unionByName(bare))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(got.groupBy("concept_slug", F.col("paper_slug").isNull().alias("bare")).count(), "concept_slug", "bare", "count") == sorted([("c", False, n // 2), ("d", False, n), ("c", True, 1), (None, True, 1)], key=str)


def test_slugs_are_free_over_the_whole_store(spark):
    made = spark.createDataFrame([("t", "k1", "foo", "1", "a"), ("t", "k2", "foo", "1", "b"), ("t", "k3", "foo-3", "1", "c"), ("t", "k4", "ok", "1", "d"), ("u", "k5", "foo", "1", "e")], "node_type string, comp string, slug string, created_at string, made string")
    taken = spark.createDataFrame([("t", "foo"), ("t", "foo-2"), ("t", "foo-99999999999")], "node_type string, slug string")
    assert rows(R.free_slugs(made, taken), "comp", "free") == [("k1", "foo-4"), ("k2", "foo-5")]


def test_json_of_papers_survives(spark):
    df = second(spark)
    back = df.select(F.from_json(F.to_json(F.struct(*df.columns)), stream.ARRIVING).alias("x")).select("x.*")
    strip = lambda d: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in d.collect())
    assert strip(back) == strip(df) and back.schema == stream.ARRIVING and EXTRACTION.fields == stream.ARRIVING.fields[:-1]


def test_mirror_is_written_as_one_version(spark, tmp_path):
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    root = str(tmp_path)
    assert vault.write_graph(frame("a"), frame("x", "y"), root) == 1
    assert vault.write_graph(frame("b", "c"), frame("z"), root) == 2
    frame("torn").write.parquet(f"{root}/nodes-torn")  # a writer that stopped before its record
    assert [rows(t, "id") for t in vault.read_graph(spark, root)] == [[("b",), ("c",)], [("z",)]]
    assert [rows(t, "id") for t in vault.read_graph(spark, root, 1)] == [[("a",)], [("x",), ("y",)]]


def test_labels_that_papers_used_become_aliases(spark):
    nodes = spark.createDataFrame([("concept", "a", "Alpha", ["z"]), ("concept", "b", "Beta", None), ("entity", "a", "Other", None)], "node_type string, slug string, display_label string, aliases array<string>")
    seen = spark.createDataFrame([("concept", "a", "alpha"), ("concept", "a", "Alpha Two"), ("concept", "a", "Alpha Two"), ("concept", "gone", "x")], "node_type string, slug string, label string")
    assert rows(ST.with_label_aliases(nodes, seen), "node_type", "slug", "aliases") == [("concept", "a", ["Alpha Two", "z"]), ("concept", "b", None), ("entity", "a", None)]


def test_missing_brains_are_errors_and_first_folders_are_the_oldest(spark):
    brains = spark.createDataFrame([("b1",), ("b2",)], "id string")
    folders = spark.createDataFrame([("f1", "b1", "2024"), ("f2", "b2", "2020"), ("f3", None, None)], "id string, brain_id string, created_at string")
    direct = spark.createDataFrame([("b2", "p9")], "brain_id string, paper_slug string")
    for wrong in (lambda: SC.merge_brains(folders, direct, "b1", "no", brains), lambda: SC.merge_brains(folders, direct, "no", "b1", brains), lambda: SC.delete_brain(brains, folders, direct, "no")):
        with pytest.raises(KeyError):
            wrong()
    f, d, b = SC.merge_brains(folders, direct, "b1", "b2", brains)
    assert rows(f, "id", "brain_id") == [("f1", "b1"), ("f2", "b1"), ("f3", None)] and rows(d, "brain_id") == [("b1",)] and rows(b, "id") == [("b1",)]
    papers = spark.createDataFrame([("p1",), ("p2",), ("p9",)], "slug string")
    inside = spark.createDataFrame([("f1", "p1"), ("f2", "p1"), ("f2", "p2"), ("f3", "p2")], "folder_id string, paper_slug string")
    assert rows(SC.paper_brain(papers, folders, inside, direct), "paper_slug", "brain_id") == [("p1", "b2"), ("p2", None), ("p9", "b2")]


def test_stream_bands_each_name_once(spark, tmp_path):
    """Forty papers with two names between them: these are signed and banded twice in all, not for every paper (F2, F3)."""
    papers = spark.createDataFrame([(*paper(f"p{i:02}", [("c", "State Spaces 20480" if i % 2 else "State Space 20480")]), None) for i in range(40)], stream.ARRIVING)
    papers.select(F.to_json(F.struct("*")).alias("value")).repartition(2).write.text(str(tmp_path / "inbox"))
    query = stream.start(spark, str(tmp_path / "inbox"), str(tmp_path / "store"), str(tmp_path / "state"), files_per_batch=1, buckets=2)
    query.awaitTermination()
    names = {o["operatorName"]: o["numRowsTotal"] for o in query.recentProgress[1]["stateOperators"]}
    assert names["dedupe"] == 2
    after = versions.opened(spark, str(tmp_path / "store"))
    assert after.table("nodes").count() == 2 - 1 and after.table("mentions").count() == 40
