"""Ingest of extracted papers as one operation: duplicates, replaced papers, resolution of names, mentions, relations, merge candidates.

The operation sees a store through ``rows`` and ``index``, so the same code serves tables that are read whole (``Whole``) and tables in buckets of which only those that a batch touches are read and
written (``sources.versions``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_label
from . import resolve as R
from . import store as ST
from .components import cut

TABLES = {
    "papers": "slug string, title string, text_hash string",
    "nodes": f"node_type string, {R.NODE}, redirect_to string",
    "mentions": "node_type string, node_slug string, paper_slug string, paper_title string, concept_slug string",
    "relations": "from_type string, from_slug string, rel_type string, to_type string, to_slug string, rationale string, sources array<string>",
    "candidates": "type string, slug_a string, slug_b string, via_alias string, detected_in_paper string, detected_at string, status string, rejected_at string, merged_at string",
}
#: Ways into the tables by other keys. They may hold more than there is (a name that a node has lost), never less: what they lead to is looked at itself.
INDEXES = {
    "names": "key string, node_type string, slug string",
    "by_paper": "paper_slug string, node_type string, node_slug string",
    "waiting": "concept_slug string, node_slug string",
    "hashes": "text_hash string, slug string",
}
KINDS = (("concept", "concepts"), ("entity", "entities"))


def empty(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], kind) for name, kind in TABLES.items()}


def typed_names(nodes: DataFrame) -> DataFrame:
    """``names`` of live nodes."""
    listed = F.concat(F.array("display_label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.filter("redirect_to is null").select("node_type", "slug", F.explode(listed).alias("name")).select(normalize_label(F.col("name")).alias("key"), "node_type", "slug").filter("key <> ''").distinct()


def indexes_of(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    m = tables["mentions"]
    return {
        "names": typed_names(tables["nodes"]),
        "by_paper": m.filter("paper_slug is not null").select("paper_slug", "node_type", "node_slug").distinct(),
        "waiting": m.filter("node_type = 'entity' and paper_slug is null and concept_slug is not null").select("concept_slug", "node_slug").distinct(),
        "hashes": tables["papers"].filter("text_hash is not null").select("text_hash", "slug"),
    }


class Whole:
    """A store whose tables are read whole."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = {**tables, "nodes": complete(tables["nodes"], TABLES["nodes"]), "candidates": complete(tables["candidates"], TABLES["candidates"])}
        self.indexes = indexes_of(self.tables)

    def rows(self, name: str, *keys: DataFrame) -> DataFrame:
        """A table, or at least its rows of the keys (one column, by which the table is kept)."""
        return self.tables[name]

    def index(self, name: str, *keys: DataFrame) -> DataFrame:
        return self.indexes[name]


def complete(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` with null columns where they lack some of ``kind``."""
    fields = [c.split() for c in kind.split(", ")]
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in fields if c not in rows.columns}).select(*(c for c, _ in fields))


def first_copies(extractions: DataFrame, store) -> DataFrame:
    """One extraction of each paper slug (of several the least by text and content), of each text only the least paper's, and none whose text the store has under another slug."""
    e = extractions if "text_hash" in extractions.columns else extractions.withColumn("text_hash", F.lit(None).cast("string"))
    nth = F.row_number().over(Window.partitionBy("paper_slug").orderBy("text_hash", F.to_json(F.struct(*(c for c in e.columns if c != "text_hash")))))
    e = e.withColumn("__n", nth).filter("__n = 1").drop("__n")
    hashed = e.filter("text_hash is not null").select("text_hash", "paper_slug")
    least = hashed.groupBy("text_hash").agg(F.min("paper_slug").alias("first"))
    known = store.index("hashes", hashed.select("text_hash")).select("text_hash", F.col("slug").alias("paper_slug"))
    # a hash that a paper once had doesn't count
    now = store.rows("papers", e.select("paper_slug"), known.join(hashed.select("text_hash"), "text_hash", "left_semi").select("paper_slug"))
    known = now.filter("text_hash is not null").groupBy("text_hash").agg(F.min("slug").alias("there"))
    e = e.join(least, "text_hash", "left").join(known, "text_hash", "left")
    return e.filter("text_hash is null or coalesce(there, first) = paper_slug").drop("first", "there")


def named(fresh: DataFrame, kind: str, column: str, at: str) -> DataFrame:
    """Names of one kind in order of paper and place."""
    rows = fresh.select("paper_slug", "title", F.posexplode(column).alias("pos", "x")).filter("trim(coalesce(x.label, '')) <> ''")
    fields = {f.name for f in fresh.schema[column].dataType.elementType.fields}
    x = lambda c, t="string": (F.col(f"x.{c}") if c in fields else F.lit(None)).cast(t).alias(c)
    seq = F.concat("paper_slug", F.lit("/"), F.lpad(F.col("pos").cast("string"), 9, "0"))
    return rows.select(seq.alias("seq"), "paper_slug", F.col("title").alias("paper_title"), x("id"), x("label"), x("aliases", "array<string>"), x("description"), x("note"), x("categories", "array<string>"),
                       (x("concept_id") if kind == "entity" else F.lit(None).cast("string").alias("concept_id")), F.lit(at).alias("at"))


def changed(extractions: DataFrame, store, types: DataFrame, at: str, pairs: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The rows that ``store`` gave, as they are afterwards, by table; and what the indexes gain. ``pairs``: node_type, a, b of keys that match, where an index has them."""
    fresh = cut(first_copies(extractions, store))
    papers = store.rows("papers", fresh.select("paper_slug"))
    again = cut(papers.select(F.col("slug").alias("paper_slug")).join(fresh.select("paper_slug"), "paper_slug", "left_semi").distinct())
    replaced = not again.isEmpty()
    said = store.index("by_paper", again).join(again, "paper_slug", "left_semi").select("node_type", "node_slug", "paper_slug") if replaced else None
    before = [said.select("node_slug")] if replaced else []
    arrivals = None
    for kind, column in KINDS:
        mine = named(fresh, kind, column, at).withColumn("node_type", F.lit(kind))
        arrivals = mine if arrivals is None else arrivals.unionByName(mine)
    arrivals = cut(arrivals)
    keys = R.typed_keys(arrivals)
    if pairs is not None:
        pairs = cut(pairs.distinct())
        keys = keys.unionByName(pairs.select("node_type", F.explode(F.array("a", "b")).alias("key")))
    met = store.index("names", keys.select("key")).join(keys, ["node_type", "key"], "left_semi").select("slug")
    nodes = store.rows("nodes", met, arrivals.select(R.slug_of(F.col("label")).alias("slug")), *before)
    if replaced:
        # mentions of replaced papers go first, and with them the nodes that nothing else mentions
        left, had = ST.remove_paper(store.rows("mentions", *before), again)
        had = cut(had.withColumnRenamed("node_slug", "slug"))
        lost = said.groupBy("node_type", F.col("node_slug").alias("slug")).agg(F.collect_set("paper_slug").alias("lost"))
        nodes = nodes.join(had.filter("deleted"), ["node_type", "slug"], "left_anti").join(lost, ["node_type", "slug"], "left")
        nodes = cut(nodes.withColumn("papers", F.when(F.col("lost").isNotNull(), F.array_except("papers", "lost")).otherwise(F.col("papers"))).drop("lost"))
    live, own = nodes.filter("redirect_to is null"), ["node_type", "seq"]
    known, candidates, assigned = R.resolve_typed(arrivals, live.drop("redirect_to"), pairs, nodes.select("node_type", "slug"))
    after = cut(known.withColumn("redirect_to", F.lit(None).cast("string")).unionByName(nodes.filter("redirect_to is not null")))
    ids = cut(arrivals.join(assigned.withColumnRenamed("arrival", "seq"), own).select(*own, "paper_slug", "paper_title", "id", F.col("assigned").alias("slug"), "concept_id"))
    # of names with one id in a paper the last counts, as if each were written over the one before
    by_id = ids.filter("id is not null").groupBy("paper_slug", "node_type", "id").agg(F.max_by("slug", "seq").alias("slug"))
    concept = by_id.filter("node_type = 'concept'").select("paper_slug", F.col("id").alias("concept_id"), F.col("slug").alias("concept_slug"))
    requests = ids.join(concept, ["paper_slug", "concept_id"], "left").groupBy("node_type", F.col("slug").alias("node_slug"), "paper_slug")
    requests = cut(requests.agg(F.max("paper_title").alias("paper_title"), F.max_by("concept_slug", "seq").alias("concept_slug")))
    linked = requests.filter("node_type = 'concept'").select(F.col("node_slug").alias("concept_slug"))
    waiting = store.index("waiting", linked).join(linked.distinct(), "concept_slug", "left_semi").select("node_slug")
    mentions = store.rows("mentions", requests.select("node_slug"), waiting, *before)
    if replaced:
        mentions = mentions.join(again, "paper_slug", "left_anti").select(*mentions.columns)
    drawn = fresh.select("paper_slug", F.posexplode("relationships").alias("pos", "x")).select("paper_slug", "pos", "x.*")
    new = cut(ST.ingest_relations(drawn, by_id, types).withColumnRenamed("pos", "place").withColumn("batch", F.lit(1)))
    there = store.rows("relations", new.select("from_slug"))
    # a relation without papers stays, and its papers keep their places
    old = there.select(*ST.RELATION, "rationale", F.posexplode_outer("sources").alias("place", "paper_slug")).withColumn("batch", F.lit(0))
    order = F.when(F.col("batch") == 0, F.struct(F.lit(0).alias("batch"), F.lit("").alias("paper"), F.coalesce("place", F.lit(0)).alias("place"))).otherwise(F.struct(F.lit(1).alias("batch"), F.col("paper_slug").alias("paper"), F.col("place").alias("place")))
    queue = store.rows("candidates", candidates.select(F.least("slug_a", "slug_b").alias("slug")))
    tables = {
        "papers": papers.join(fresh.select(F.col("paper_slug").alias("slug")), "slug", "left_anti").select("slug", "title", "text_hash").unionByName(fresh.select(F.col("paper_slug").alias("slug"), "title", "text_hash")),
        "nodes": after.select(*R.names_of(TABLES["nodes"])),
        "mentions": ST.link(mentions, requests),
        "relations": ST.upsert_relations(old.unionByName(new.select(*old.columns)), order),
        "candidates": queue.unionByName(complete(R.new_candidates(candidates, queue), TABLES["candidates"])),
    }
    met_now = after.join(requests.select("node_type", F.col("node_slug").alias("slug")).distinct(), ["node_type", "slug"], "left_semi")
    gains = {
        "names": typed_names(met_now),
        "by_paper": requests.select("paper_slug", "node_type", "node_slug"),
        "hashes": fresh.filter("text_hash is not null").select("text_hash", F.col("paper_slug").alias("slug")),
    }
    return tables, gains


def ingest(extractions: DataFrame, store: dict[str, DataFrame], types: DataFrame, at: str) -> dict[str, DataFrame]:
    """``extractions``: rows of ``schema.EXTRACTION``, with ``text_hash`` if known; ``store``: the tables of ``TABLES``. The tables after it.

    A paper whose text the store has under another slug, or an earlier one of the batch has, is left out. A paper that the store has is replaced: its mentions go first, and the nodes that only it mentioned; relations stay.
    Names meet the nodes of the store and each other in order of paper and place; ids within a paper become slugs in mentions and relations; entity mentions without a paper get that of a concept that is newly
    linked; relations are merged by their key, papers in order of arrival; a pair that is a candidate, in any status, isn't recorded again."""
    return {**store, **changed(extractions, Whole(store), types, at)[0]}
