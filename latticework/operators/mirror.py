"""The kept mirror of the graph: edges with the number of mentions that carry them, and brains of nodes with the number of mentions that bring them, changed by signed rows instead of made anew.

What a mention carries follows from four facts: whether its node is live, whether its concept is live, whether its paper is there, and in which brain that is. So a change of nodes and papers touches only the
mentions that name them: what these carried before is taken away and what they carry now is added; mentions that come and go are added and taken away as the facts are now. Sums of the signed rows that are
not zero are applied to the kept counts; a count of zero is a row that goes. Relations between nodes are the third kept table: one that names two live nodes is an edge.

Tables: ``live`` (nodes), ``homes`` (papers and their brains), ``ties`` (mentions, counted), ``facts`` (relations, counted), and of these ``edges``, ``tags``, ``semantic``. As in ``ingest`` a store is seen through ``rows`` and
``index`` (which here reads tables too), so the same code serves tables that are read whole and tables in buckets.

Edge cases: a change of a node or paper that is as it was changes nothing; of several changes of one in a batch the last by ``seq`` counts (ties: present before absent, then the greatest brain); mention and relation changes of a batch
add up, so one that comes and goes leaves nothing; to take away what isn't there is an error; a mention with neither concept nor paper carries nothing, and its node has no brain by it; null slugs match nothing; no changes give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MENTION = ["node_type", "node_slug", "paper_slug", "concept_slug"]
RELATION = ["from_type", "from_slug", "rel_type", "to_type", "to_slug"]
EDGE = ["src_type", "src_slug", "dst_type", "dst_slug"]
TAG = ["node_type", "node_slug", "brain_id"]


def kind(columns: list[str]) -> str:
    return ", ".join(f"{c} string" for c in columns) + ", n long"


TABLES = {
    "live": "node_type string, slug string",
    "homes": "paper_slug string, brain_id string",
    "ties": kind(MENTION),
    "facts": kind(RELATION),
    "edges": kind(EDGE),
    "tags": kind(TAG),
    "semantic": kind(RELATION),
}
#: Ways to mentions by paper and concept, and to relations by their end. They may hold more than there is, never less.
INDEXES = {
    "tie_papers": "paper_slug string, node_slug string",
    "tie_concepts": "concept_slug string, node_slug string",
    "fact_ends": "to_slug string, from_slug string",
}
#: By what each is dealt to buckets.
COLUMNS = {"live": "slug", "homes": "paper_slug", "ties": "node_slug", "facts": "from_slug", "edges": "dst_slug", "tags": "node_slug", "semantic": "from_slug", "tie_papers": "paper_slug", "tie_concepts": "concept_slug", "fact_ends": "to_slug"}
#: A log of changes. ``kind`` is node, paper, mention or relation; ``there`` says whether a node or paper is there now (a paper in ``brain_id``), ``n`` how many like mentions or relations come (below 0: go).
#: Relations take ``rel_type`` and ``to_type``, ``to_slug`` beside the node.
CHANGE = "seq long, kind string, node_type string, node_slug string, paper_slug string, concept_slug string, brain_id string, rel_type string, to_type string, to_slug string, there boolean, n long"


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def indexes_of(ties: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    return {
        "tie_papers": ties.filter("paper_slug is not null").select("paper_slug", "node_slug").distinct(),
        "tie_concepts": ties.filter("concept_slug is not null").select("concept_slug", "node_slug").distinct(),
        "fact_ends": facts.select("to_slug", "from_slug").distinct(),
    }


class Whole:
    """A mirror whose tables are read whole."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.indexes = tables, indexes_of(tables["ties"], tables["facts"])

    def rows(self, name: str, *keys: DataFrame) -> DataFrame:
        return self.tables[name]

    def index(self, name: str, *keys: DataFrame) -> DataFrame:
        return (self.tables | self.indexes)[name]


def last(changes: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """The last change of each."""
    latest = changes.groupBy(*keys).agg(F.max(F.struct("seq", *values)).alias("x"))
    return latest.select(*keys, *(F.col(f"x.{c}").alias(c) for c in values))


def sorted_out(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Changed nodes (node_type, slug, there), papers (paper_slug, there, brain_id), mentions and relations (signed)."""
    of = lambda k: changes.filter(F.col("kind") == k)
    nodes = last(of("node").select("seq", "node_type", F.col("node_slug").alias("slug"), "there").dropna(subset=["node_type", "slug", "there"]), ["node_type", "slug"], "there")
    papers = last(of("paper").filter("paper_slug is not null and there is not null"), ["paper_slug"], "there", "brain_id")
    papers = papers.withColumn("brain_id", F.when(F.col("there"), F.col("brain_id")))
    relations = of("relation").select(F.col("node_type").alias("from_type"), F.col("node_slug").alias("from_slug"), "rel_type", "to_type", "to_slug", "n")
    return nodes, papers, summed(of("mention"), MENTION), summed(relations, RELATION)


def node_states(asked: DataFrame, live: DataFrame, changed: DataFrame) -> DataFrame:
    """Of the nodes asked for (node_type, slug) whether each was live and is now."""
    a = asked.filter("slug is not null").distinct()
    was = live.select("node_type", "slug", F.lit(True).alias("was")).distinct()
    j = a.join(was, ["node_type", "slug"], "left").join(changed, ["node_type", "slug"], "left")
    was = F.coalesce("was", F.lit(False))
    return j.select("node_type", "slug", was.alias("was"), F.coalesce("there", was).alias("now"))


def paper_states(asked: DataFrame, homes: DataFrame, changed: DataFrame) -> DataFrame:
    """The same of papers, with their brains."""
    a = asked.filter("paper_slug is not null").distinct()
    was = homes.groupBy("paper_slug").agg(F.min("brain_id").alias("brain_was")).withColumn("was", F.lit(True))
    j = a.join(was, "paper_slug", "left").join(changed, "paper_slug", "left")
    was = F.coalesce("was", F.lit(False))
    changed_now = F.col("there").isNotNull()
    return j.select("paper_slug", was.alias("was"), "brain_was", F.coalesce("there", was).alias("now"), F.when(changed_now, F.col("brain_id")).otherwise(F.col("brain_was")).alias("brain_now"))


def touched(rows: DataFrame, nodes: DataFrame, *ends: tuple[Column | str, str], papers: DataFrame | None = None) -> DataFrame:
    """Rows that name a changed node at one of their ends (type, column of the slug), or a changed paper. Each row once, as often as it is there."""
    marked, marks = rows, []
    for i, (node_type, slug) in enumerate(ends):
        m = f"__m{i}"
        hit = nodes.select(F.col("node_type").alias("__t"), F.col("slug").alias("__s"), F.lit(True).alias(m))
        marked = marked.join(hit, (F.col("__t") == node_type) & (F.col("__s") == F.col(slug)), "left").drop("__t", "__s")
        marks.append(m)
    if papers is not None:
        marked = marked.join(papers.select("paper_slug", F.lit(True).alias("__p")), "paper_slug", "left")
        marks.append("__p")
    return marked.filter(F.coalesce(*marks, F.lit(False))).select(*rows.columns)


def signed(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows as they were and as they are now (``then``): those touched are taken away as they were and added as they are, those that come and go count as they are."""
    states = F.explode(F.array(F.struct(F.lit(True).alias("then"), (-F.col("n")).alias("n")), F.struct(F.lit(False).alias("then"), F.col("n").alias("n")))).alias("x")
    cols = [c for c in before.columns if c != "n"]
    return before.select(*cols, states).select(*cols, "x.then", "x.n").unionByName(fresh.select(*cols, F.lit(False).alias("then"), "n"))


def carried(store, ties: DataFrame, fresh: DataFrame, nodes: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed edges and tags of mentions: ``ties`` that changed nodes or papers touch, and mentions that come and go."""
    rows = ties.unionByName(fresh)
    asked = rows.select("node_type", F.col("node_slug").alias("slug")).unionAll(rows.select(F.lit("concept"), "concept_slug")).distinct()
    states = node_states(asked, store.index("live", asked.select("slug")), nodes)
    named = rows.select("paper_slug").distinct()
    homes = paper_states(named, store.index("homes", named), papers)
    own = states.select("node_type", F.col("slug").alias("node_slug"), F.col("was").alias("own_was"), F.col("now").alias("own_now"))
    concepts = states.filter("node_type = 'concept'").select(F.col("slug").alias("concept_slug"), F.col("was").alias("c_was"), F.col("now").alias("c_now"))
    homes = homes.withColumnsRenamed({"was": "p_was", "now": "p_now"})
    j = signed(ties, fresh).join(own, ["node_type", "node_slug"]).join(concepts, "concept_slug", "left").join(homes, "paper_slug", "left")
    at = lambda was, now: F.when(F.col("then"), F.col(was)).otherwise(F.col(now))
    j = j.filter(at("own_was", "own_now"))
    on_concept = (F.col("node_type") == "entity") & F.coalesce(at("c_was", "c_now"), F.lit(False))
    on_paper = F.coalesce(at("p_was", "p_now"), F.lit(False))
    src = F.when(on_concept, F.struct(F.lit("concept").alias("t"), F.col("concept_slug").alias("s"))).when(on_paper, F.struct(F.lit("paper").alias("t"), F.col("paper_slug").alias("s")))
    edges = j.withColumn("src", src).filter("src is not null").select(F.col("src.t").alias("src_type"), F.col("src.s").alias("src_slug"), F.col("node_type").alias("dst_type"), F.col("node_slug").alias("dst_slug"), "n")
    tags = j.withColumn("brain_id", at("brain_was", "brain_now")).filter(on_paper & F.col("brain_id").isNotNull()).select(*TAG, "n")
    return summed(edges, EDGE), summed(tags, TAG)


def related(store, facts: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Signed semantic edges, likewise."""
    rows = facts.unionByName(fresh)
    asked = rows.select(F.col("from_type").alias("node_type"), F.col("from_slug").alias("slug")).unionAll(rows.select("to_type", "to_slug")).distinct()
    states = node_states(asked, store.index("live", asked.select("slug")), nodes)
    side = lambda s: states.select(F.col("node_type").alias(f"{s}_type"), F.col("slug").alias(f"{s}_slug"), F.col("was").alias(f"{s}_was"), F.col("now").alias(f"{s}_now"))
    j = signed(facts, fresh).join(side("from"), ["from_type", "from_slug"]).join(side("to"), ["to_type", "to_slug"])
    return summed(j.filter(F.when(F.col("then"), F.col("from_was") & F.col("to_was")).otherwise(F.col("from_now") & F.col("to_now"))), RELATION)


def applied(kept: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts after signed changes; rows whose count is 0 go, one below 0 is an error."""
    rows = summed(kept.unionByName(changes.select(*kept.columns)), keys)
    wrong = F.raise_error(F.concat(F.lit("a change takes away what isn't there: "), F.to_json(F.struct(*keys))))
    return rows.withColumn("n", F.when(F.col("n") < 0, wrong.cast("long")).otherwise(F.col("n"))).select(*kept.columns)


def changed(changes: DataFrame, store, cut=lambda df: df) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, DataFrame]]:
    """A batch of changes against a mirror: the tables that it read as they are afterwards, the rows that indexes gain, and the signed rows that it came to. ``cut`` stores what several plans read.
    Tables that no change of the batch's kinds can touch are left alone."""
    kinds = {r.kind for r in changes.select("kind").filter(F.col("kind").isin("node", "paper", "mention", "relation")).distinct().collect()}
    nodes, papers, mentions, relations = (cut(x) if k in kinds else x.limit(0) for k, x in zip(("node", "paper", "mention", "relation"), sorted_out(changes)))
    now = lambda rows, keys, news: rows.join(news, keys, "left_anti").unionByName(news.filter("there").select(*rows.columns))
    after, gains, moved = {}, indexes_of(mentions.filter("n > 0"), relations.filter("n > 0")), {}
    if kinds & {"node", "paper", "mention"}:
        of_papers = store.index("tie_papers", papers.select("paper_slug")).join(papers, "paper_slug", "left_semi").select("node_slug")
        concepts = nodes.filter("node_type = 'concept'").select(F.col("slug").alias("concept_slug"))
        of_concepts = store.index("tie_concepts", concepts).join(concepts, "concept_slug", "left_semi").select("node_slug")
        tied = cut(of_papers.unionAll(of_concepts).unionAll(nodes.select("slug")).distinct())
        hit = cut(touched(store.index("ties", tied), nodes, (F.col("node_type"), "node_slug"), (F.lit("concept"), "concept_slug"), papers=papers))
        moved["edges"], moved["tags"] = (cut(x) for x in carried(store, hit, mentions, nodes, papers))
        after["edges"] = applied(store.rows("edges", moved["edges"].select("dst_slug")), moved["edges"], EDGE)
        after["tags"] = applied(store.rows("tags", moved["tags"].select("node_slug")), moved["tags"], TAG)
    if kinds & {"node", "relation"}:
        ends = store.index("fact_ends", nodes.select("slug")).join(nodes.select(F.col("slug").alias("to_slug")), "to_slug", "left_semi").select("from_slug")
        named = cut(ends.unionAll(nodes.select("slug")).distinct())
        hit = cut(touched(store.index("facts", named), nodes, (F.col("from_type"), "from_slug"), (F.col("to_type"), "to_slug")))
        moved["semantic"] = cut(related(store, hit, relations, nodes))
        after["semantic"] = applied(store.rows("semantic", moved["semantic"].select("from_slug")), moved["semantic"], RELATION)
    if "node" in kinds:
        after["live"] = now(store.rows("live", nodes.select("slug")), ["node_type", "slug"], nodes)
    if "paper" in kinds:
        after["homes"] = now(store.rows("homes", papers.select("paper_slug")), ["paper_slug"], papers)
    if "mention" in kinds:
        after["ties"] = applied(store.rows("ties", mentions.select("node_slug")), mentions, MENTION)
    if "relation" in kinds:
        after["facts"] = applied(store.rows("facts", relations.select("from_slug")), relations, RELATION)
    gains = {t: rows for t, rows in gains.items() if ("relation" if t == "fact_ends" else "mention") in kinds}
    return after, gains, moved


def whole(nodes: DataFrame, of_paper: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """All tables made at once: ``nodes`` (node_type, slug), ``of_paper`` (paper_slug, brain_id: a row for each paper), mentions and relations as bags."""
    spark = nodes.sparkSession
    one = lambda rows, keys: rows.select(*keys, F.lit(1).cast("long").alias("n"))
    none = {t: spark.createDataFrame([], k) for t, k in TABLES.items()}
    live, homes = nodes.select("node_type", "slug").distinct(), of_paper.groupBy("paper_slug").agg(F.min("brain_id").alias("brain_id"))
    ties, facts = summed(one(mentions, MENTION), MENTION), summed(one(relations, RELATION), RELATION)
    there = Whole({**none, "live": live, "homes": homes})
    no_nodes, no_papers = live.select("*", F.lit(True).alias("there")).limit(0), homes.select("paper_slug", F.lit(True).alias("there"), "brain_id").limit(0)
    edges, tags = carried(there, none["ties"], ties, no_nodes, no_papers)
    return {"live": live, "homes": homes, "ties": ties, "facts": facts, "edges": edges, "tags": tags, "semantic": related(there, none["facts"], facts, no_nodes)}


def brain_ids(live: DataFrame, tags: DataFrame) -> DataFrame:
    """``node_type``, ``slug``, sorted ``brain_ids`` of every live node, none for one without."""
    t = tags.groupBy("node_type", F.col("node_slug").alias("slug")).agg(F.sort_array(F.collect_set("brain_id")).alias("brain_ids"))
    return live.join(t, ["node_type", "slug"], "left").select("node_type", "slug", F.coalesce("brain_ids", F.array().cast("array<string>")).alias("brain_ids"))
