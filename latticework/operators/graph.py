"""Provenance and semantic graph views, and queries on them. Edges are bags unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import md_images, wikilinks
from ..schema import IMAGE_EXTENSIONS
from .components import cut


def ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_type", "slug", F.concat_ws(":", "node_type", "display_label").alias("id"), F.col("display_label").alias("label"))


def graph_nodes(papers: DataFrame, nodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """``id``, ``label``, ``type``, ``orphan`` of notes, tags, concepts and entities; orphans have no mention at all."""
    seen = mentions.select("node_type", F.col("node_slug").alias("slug")).distinct().withColumn("seen", F.lit(True))
    n = ids(nodes).join(seen, ["node_type", "slug"], "left").select("id", "label", F.col("node_type").alias("type"), F.col("seen").isNull().alias("orphan"))
    no = F.lit(False).alias("orphan")
    p = papers.select(F.col("slug").alias("id"), F.col("title").alias("label"), F.lit("note").alias("type"), no)
    t = papers.select("tag").filter("tag is not null").distinct().select(F.concat(F.lit("tag:"), "tag").alias("id"), F.col("tag").alias("label"), F.lit("tag").alias("type"), no)
    return p.unionByName(t).unionByName(n)


def tag_edges(papers: DataFrame) -> DataFrame:
    return papers.filter("tag is not null").select(F.col("slug").alias("source"), F.concat(F.lit("tag:"), "tag").alias("target"), F.lit("tag").alias("type"))


def entity_sources(papers: DataFrame, concepts: DataFrame, entity_mentions: DataFrame) -> DataFrame:
    """Where each entity mention hangs: on its concept if that is live, else on its paper if that exists, else nowhere."""
    c = concepts.select(F.col("slug").alias("concept_slug"), F.concat(F.lit("concept:"), "display_label").alias("concept_id"))
    p = papers.select(F.col("slug").alias("paper_slug"), F.col("slug").alias("paper_id"))
    j = entity_mentions.join(c, "concept_slug", "left").join(p, "paper_slug", "left")
    return j.withColumn("source", F.coalesce("concept_id", "paper_id")).filter("source is not null")


def provenance_edges(papers: DataFrame, concepts: DataFrame, entities: DataFrame, concept_mentions: DataFrame, entity_mentions: DataFrame, typed: bool = False) -> DataFrame:
    """Paper to concept, and concept or paper to entity: one edge for each mention. With ``typed`` also the types of both ends."""
    c = concepts.select(F.col("slug").alias("node_slug"), F.concat(F.lit("concept:"), "display_label").alias("target"))
    e = entities.select(F.col("slug").alias("node_slug"), F.concat(F.lit("entity:"), "display_label").alias("target"))
    p = papers.select(F.col("slug").alias("paper_slug"))
    link = F.lit("link").alias("type")
    first = concept_mentions.join(c, "node_slug").join(p, "paper_slug", "left_semi").select(F.col("paper_slug").alias("source"), "target", link, F.lit("note").alias("source_type"), F.lit("concept").alias("target_type"))
    kind = F.when(F.col("concept_id").isNotNull(), "concept").otherwise("note")
    second = entity_sources(papers, concepts, entity_mentions).join(e, "node_slug").select("source", "target", link, kind.alias("source_type"), F.lit("entity").alias("target_type"))
    both = first.unionByName(second)
    return both if typed else both.select("source", "target", "type")


def semantic_edges(relations: DataFrame, nodes: DataFrame, types: DataFrame, typed: bool = False) -> DataFrame:
    """Relations between live nodes; symmetric by vocabulary, else not."""
    n = ids(nodes)
    side = lambda s: n.select(F.col("node_type").alias(f"{s}_type"), F.col("slug").alias(f"{s}_slug"), F.col("id").alias(f"{s}_id"))
    j = relations.join(side("from"), ["from_type", "from_slug"]).join(side("to"), ["to_type", "to_slug"]).join(types, "rel_type", "left")
    return j.select(
        F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lit("semantic").alias("type"),
        F.col("rel_type").alias("relation"), F.coalesce("symmetric", F.lit(False)).alias("symmetric"),
        *((F.col("from_type").alias("source_type"), F.col("to_type").alias("target_type")) if typed else ()),
    )


def mirror_edges(papers: DataFrame, concepts: DataFrame, entities: DataFrame, concept_mentions: DataFrame, entity_mentions: DataFrame) -> DataFrame:
    """The same by slugs, as a set: ``src_type``, ``src_slug``, ``dst_type``, ``dst_slug``."""
    p = papers.select(F.col("slug").alias("paper_slug"))
    live_c, live_e = (x.select(F.col("slug").alias("node_slug")) for x in (concepts, entities))
    out = lambda d, st, ss, dt, ds: d.select(st.alias("src_type"), ss.alias("src_slug"), F.lit(dt).alias("dst_type"), ds.alias("dst_slug"))
    first = concept_mentions.join(live_c, "node_slug", "left_semi").join(p, "paper_slug", "left_semi")
    second = entity_sources(papers, concepts, entity_mentions).join(live_e, "node_slug", "left_semi")
    on_concept = F.col("concept_id").isNotNull()
    return out(first, F.lit("paper"), F.col("paper_slug"), "concept", F.col("node_slug")).unionByName(
        out(second, F.when(on_concept, "concept").otherwise("paper"), F.when(on_concept, F.col("concept_slug")).otherwise(F.col("paper_slug")), "entity", F.col("node_slug"))
    ).distinct()


def ends_typed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``source_type`` and ``target_type``, joined from the nodes unless whoever made the edges knew them."""
    if "source_type" in edges.columns:
        return edges
    kind = nodes.select("id", "type").distinct()
    e = edges.join(kind.select(F.col("id").alias("source"), F.col("type").alias("source_type")), "source", "left")
    return e.join(kind.select(F.col("id").alias("target"), F.col("type").alias("target_type")), "target", "left")


def focus_subgraph(nodes: DataFrame, edges: DataFrame, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges around a few papers (``focus``: id): their neighbours and all orphans, then the entities of the concepts among these and the attachments of
    all. One pass over all edges, one over those from concepts to entities and those to attachments, no iteration. Edges stay if both ends do."""
    e = ends_typed(edges, nodes)
    f = focus.select("id").distinct()
    side = lambda c: f.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_in"))
    # an edge from a focus paper adds its target; only an edge that doesn't start there adds its source
    hit = e.join(side("source"), "source", "left").join(side("target"), "target", "left").filter("source_in or target_in")
    pick = lambda a, b: F.when(F.col("source_in"), F.col(a)).otherwise(F.col(b))
    near = hit.select(pick("target", "source").alias("id"), pick("target_type", "source_type").alias("type"))
    kept = near.unionByName(nodes.filter("orphan").select("id", "type")).unionByName(f.withColumn("type", F.lit("note"))).distinct()
    kept = cut(kept)  # used several times below: without a cut the plan would repeat all of it each time
    concepts = kept.filter("type = 'concept'").select(F.col("id").alias("source"))
    entities = e.filter("source_type = 'concept' and target_type = 'entity'").join(concepts, "source", "left_semi").select(F.col("target").alias("id"))
    kept = kept.select("id").unionByName(entities).distinct()
    attached = e.filter("target_type = 'attachment'").join(kept.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    kept = cut(kept.unionByName(attached).distinct())
    return nodes.join(kept, "id", "left_semi"), among(edges, kept)


def among(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of which both ends are kept (``id``)."""
    return edges.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")


def visible(nodes: DataFrame, edges: DataFrame, hidden: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some types. Edges that know the types of their ends are filtered by these; others meet the nodes."""
    kept = nodes.filter(~F.col("type").isin(*hidden))
    if "source_type" in edges.columns:
        return kept, edges.filter(~F.col("source_type").isin(*hidden) & ~F.col("target_type").isin(*hidden))
    return kept, among(edges, kept)


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """A node and all that an edge ties to it."""
    hit = edges.filter((F.col("source") == node) | (F.col("target") == node))
    return hit.select(F.explode(F.array("source", "target")).alias("id")).union(edges.sparkSession.createDataFrame([(node,)], "id string")).distinct()


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count_if(F.col("type") == "note").alias("papers"), F.count_if(F.col("type").isin("concept", "entity")).alias("nodes"))


def is_image(target: Column) -> Column:
    return F.lower(F.regexp_extract(target, r"(\.[^./]+)/*$", 1)).isin(*IMAGE_EXTENSIONS)


def attachment_edges(owners: DataFrame, owner_type: str = "note") -> tuple[DataFrame, DataFrame]:
    """``owners``: id, body[, slug]. Attachment nodes (distinct by owner and name) and edges. A note's attachments are a set of embedded and Markdown images, those of a node
    file (its user section) a bag of Markdown images."""
    body = F.col("body")
    images = md_images(body)
    if owner_type == "note":
        images = F.array_distinct(F.concat(F.filter(wikilinks(body), is_image), images))
    slug = F.col("slug") if "slug" in owners.columns else F.col("id")
    name = F.coalesce(F.nullif(F.regexp_extract("src", r"([^/]+)/*$", 1), F.lit("")), F.col("src"))
    links = owners.select("id", slug.alias("owner_slug"), F.explode(images).alias("src")).withColumn("label", name)
    links = links.withColumn("target", F.concat_ws(":", F.lit("attachment"), "id", "label"))
    nodes = links.groupBy(F.col("target").alias("id"), "label", "owner_slug").agg(F.min("src").alias("src"))
    nodes = nodes.select("id", "label", F.lit("attachment").alias("type"), F.lit(False).alias("orphan"), F.lit(owner_type).alias("owner_type"), "owner_slug", "src")
    return nodes, links.select(F.col("id").alias("source"), "target", F.lit("link").alias("type"))


def wikilink_edges(notes: DataFrame) -> DataFrame:
    """``notes``: slug, body. Links between notes: a target counts once for each note; unknown ones, drawings and embedded images don't; a note may link itself."""
    links = notes.select(F.col("slug").alias("source"), F.explode(wikilinks(F.col("body"))).alias("target")).filter(~F.lower("target").endswith(".excalidraw") & ~is_image(F.col("target")))
    return links.join(notes.select(F.col("slug").alias("target")), "target", "left_semi").select("source", "target", F.lit("link").alias("type"))


def build(papers: DataFrame, concepts: DataFrame, entities: DataFrame, concept_mentions: DataFrame, entity_mentions: DataFrame, notes: DataFrame | None = None, node_bodies: DataFrame | None = None,
          relations: DataFrame | None = None, types: DataFrame | None = None, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole graph view: nodes (id, label, type, orphan, owner_type, owner_slug, src) and edges (source, target, type, relation). ``notes``: slug, body of papers, for links between notes and
    attachments; ``node_bodies``: id, slug, type, body (user sections). ``relations`` and ``types`` add the semantic edges; ``focus`` (id) keeps what lies around some papers."""
    label = lambda t, d: d.select(F.lit(t).alias("node_type"), "slug", "display_label")
    mentions = concept_mentions.select(F.lit("concept").alias("node_type"), "node_slug").unionByName(entity_mentions.select(F.lit("entity").alias("node_type"), "node_slug"))
    all_nodes = label("concept", concepts).unionByName(label("entity", entities))
    nodes = graph_nodes(papers, all_nodes, mentions)
    kinds = lambda d, a, b: d.withColumns({"source_type": F.lit(a), "target_type": F.lit(b)})
    edges = provenance_edges(papers, concepts, entities, concept_mentions, entity_mentions, typed=True).unionByName(kinds(tag_edges(papers), "note", "tag"))
    attached = []
    if notes is not None:
        edges = edges.unionByName(kinds(wikilink_edges(notes), "note", "note"))
        attached.append((attachment_edges(notes.select(F.col("slug").alias("id"), "slug", "body")), "note"))
    for t in ("concept", "entity") if node_bodies is not None else ():
        attached.append((attachment_edges(node_bodies.filter(F.col("type") == t), t), t))
    for (n, e), t in attached:
        nodes = nodes.unionByName(n, allowMissingColumns=True)
        edges = edges.unionByName(kinds(e, t, "attachment"))
    edges = edges.withColumn("relation", F.lit(None).cast("string"))
    if relations is not None:
        edges = edges.unionByName(semantic_edges(relations, all_nodes, types, typed=True).drop("symmetric"))
    if focus is not None:
        nodes, edges = focus_subgraph(nodes, edges, focus)
    return nodes, edges.drop("source_type", "target_type")
