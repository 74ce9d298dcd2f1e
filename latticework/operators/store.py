"""Node store: links, unlinks, relations and names as set-based transforms of normalised tables.

Tables: ``mentions`` (node_type, node_slug, paper_slug, paper_title, concept_slug), ``relations`` (from_type, from_slug, rel_type, to_type, to_slug, rationale,
sources), ``nodes``. Every transform takes batches of requests and returns the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key, normalize_label

NODE = ["node_type", "node_slug"]
RELATION = ["from_type", "from_slug", "rel_type", "to_type", "to_slug"]


def link(mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: node_type, node_slug, paper_slug, paper_title, concept_slug; one for each node and paper (of several one counts, the greatest by concept). A mention of the paper gets the new concept (null too);
    without a paper the mention with that concept and no paper is the one. Else a mention is added. New concept links fill paperless entity mentions of the concept.

    Both cases are equi-joins on all that identifies a mention, so a hub's mentions and requests don't meet each other one by one."""
    titled, bare = "paper_slug is not null", "paper_slug is null"
    r = requests.filter(titled).groupBy(*NODE, "paper_slug").agg(F.max(F.struct("concept_slug", "paper_title")).alias("new"))
    m, kept = mentions.filter(titled), mentions.filter(bare).select(*NODE, "paper_slug", "paper_title", "concept_slug")
    j = m.join(r, [*NODE, "paper_slug"], "left").select(*NODE, "paper_slug", "paper_title", F.when(F.col("new").isNotNull(), F.col("new.concept_slug")).otherwise(F.col("concept_slug")).alias("concept_slug"))
    added = r.join(m.select(*NODE, "paper_slug").distinct(), [*NODE, "paper_slug"], "left_anti").select(*NODE, "paper_slug", F.col("new.paper_title").alias("paper_title"), F.col("new.concept_slug").alias("concept_slug"))
    b = requests.filter(bare).select(*NODE, "paper_slug", "paper_title", "concept_slug").dropDuplicates([*NODE, "concept_slug"]).alias("b")
    k = kept.alias("k")
    same = (F.col("k.node_type") == F.col("b.node_type")) & (F.col("k.node_slug") == F.col("b.node_slug")) & F.col("k.concept_slug").eqNullSafe(F.col("b.concept_slug"))
    without = kept.unionByName(b.join(k, same, "left_anti"))
    return propagate(j.unionByName(added).unionByName(without), requests.filter("node_type = 'concept' and paper_slug is not null"))


def propagate(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Paperless entity mentions of a concept get the paper that the concept was linked to; of several papers the least."""
    l = links.groupBy(F.col("node_slug").alias("concept_slug")).agg(F.min(F.struct("paper_slug", "paper_title")).alias("p"))
    j = mentions.join(l, "concept_slug", "left")
    fill = (F.col("node_type") == "entity") & F.col("paper_slug").isNull() & F.col("p").isNotNull()
    return j.select(*NODE, F.when(fill, F.col("p.paper_slug")).otherwise(F.col("paper_slug")).alias("paper_slug"), F.when(fill, F.col("p.paper_title")).otherwise(F.col("paper_title")).alias("paper_title"), "concept_slug")


def remove_paper(mentions: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``papers``: paper_slug. Mentions without theirs, and the nodes that had some: (node_type, node_slug, deleted), deleted if nothing is left."""
    p = papers.select("paper_slug").distinct()
    left = mentions.join(p, "paper_slug", "left_anti").select(*mentions.columns)
    had = mentions.join(p, "paper_slug", "left_semi").select(*NODE).distinct()
    still = left.select(*NODE).distinct().withColumn("still", F.lit(True))
    return left, had.join(still, NODE, "left").select(*NODE, F.col("still").isNull().alias("deleted"))


def unlink_paper(mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: node_type, node_slug, paper_slug. The node loses the mention but stays, an orphan perhaps. Entity mentions through an unlinked concept go if
    another mention of the entity has that concept; else they lose their paper."""
    r = requests.select(*NODE, "paper_slug").distinct()
    left = mentions.join(r, [*NODE, "paper_slug"], "left_anti").select(*mentions.columns)
    gone = r.filter("node_type = 'concept'").select(F.col("node_slug").alias("concept_slug"), "paper_slug", F.lit(True).alias("cut"))
    j = left.join(gone, ["concept_slug", "paper_slug"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)) & (F.col("node_type") == "entity"))
    other = j.filter(~F.col("cut") & F.col("concept_slug").isNotNull()).select(*NODE, "concept_slug", F.lit(True).alias("other")).distinct()
    j = j.join(other, [*NODE, "concept_slug"], "left").filter(~(F.col("cut") & F.coalesce("other", F.lit(False))))
    empty = lambda c: F.when(~F.col("cut"), F.col(c)).alias(c)
    return j.select(*NODE, empty("paper_slug"), *([empty("paper_title")] if "paper_title" in mentions.columns else []), "concept_slug").distinct()


def unlink_concept(mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: node_slug (entity), concept_slug. All mentions of the entity through the concept go."""
    r = requests.select(F.lit("entity").alias("node_type"), "node_slug", "concept_slug").distinct()
    return mentions.join(r, [*NODE, "concept_slug"], "left_anti").select(*mentions.columns)


def delete_nodes(nodes: DataFrame, mentions: DataFrame, relations: DataFrame, gone: DataFrame, cascade: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``gone``: node_type, slug. Without them, their mentions and the relations that touch them; with ``cascade`` also the entities that hang on a concept among them."""
    g = gone.select("node_type", "slug").distinct()
    if cascade:
        concept = g.filter("node_type = 'concept'").select(F.col("slug").alias("concept_slug"))
        g = g.unionByName(mentions.filter("node_type = 'entity'").join(concept, "concept_slug", "left_semi").select("node_type", F.col("node_slug").alias("slug"))).distinct()
    side = lambda t, s: g.select(F.col("node_type").alias(t), F.col("slug").alias(s))
    rest = relations.join(side("from_type", "from_slug"), ["from_type", "from_slug"], "left_anti").join(side("to_type", "to_slug"), ["to_type", "to_slug"], "left_anti")
    return nodes.join(g, ["node_type", "slug"], "left_anti"), mentions.join(side(*NODE), NODE, "left_anti"), rest.select(*relations.columns)


def symmetric(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Symmetric relations run from the lesser end (type, slug) to the greater."""
    j = relations.join(types.select("rel_type", "symmetric"), "rel_type", "left")
    swap = F.coalesce("symmetric", F.lit(False)) & (F.struct("from_type", "from_slug") > F.struct("to_type", "to_slug"))
    pick = lambda a, b, c: F.when(swap, F.col(a)).otherwise(F.col(b)).alias(c)
    ends = {f"{x}_{k}": pick(f"{y}_{k}", f"{x}_{k}", f"{x}_{k}") for x, y in (("from", "to"), ("to", "from")) for k in ("type", "slug")}
    return j.select(*(ends.get(c, F.col(c)) for c in relations.columns))


def upsert_relations(arrivals: DataFrame, order: Column | None = None) -> DataFrame:
    """``arrivals``: the key, rationale, paper_slug, in an order. One relation for each key: distinct papers in order, and the first rationale that isn't empty."""
    at = order if order is not None else F.struct("paper_slug", "rationale")
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = arrivals.withColumn("__at", at)
    g = rows.groupBy(*RELATION).agg(
        F.array_sort(F.collect_set(F.when(some("paper_slug"), F.struct("__at", "paper_slug")))).alias("s"),
        F.min_by(F.when(some("rationale"), F.col("rationale")), F.when(some("rationale"), F.col("__at"))).alias("rationale"),
    )
    return g.select(*RELATION, F.coalesce("rationale", F.lit("")).alias("rationale"), F.array_distinct(F.col("s.paper_slug")).alias("sources"))


def ingest_relations(drawn: DataFrame, ids: DataFrame, types: DataFrame) -> DataFrame:
    """``drawn``: paper_slug, from_type, from_id, to_type, to_id, type, rationale. ``ids``: paper_slug, node_type, id, slug. Ids become slugs; unknown ids or types and
    self relations are dropped; symmetric ones are put in order."""
    side = lambda s: ids.select("paper_slug", F.col("node_type").alias(f"{s}_type"), F.col("id").alias(f"{s}_id"), F.col("slug").alias(f"{s}_slug"))
    j = drawn.join(side("from"), ["paper_slug", "from_type", "from_id"]).join(side("to"), ["paper_slug", "to_type", "to_id"]).withColumnRenamed("type", "rel_type")
    j = j.filter(~((F.col("from_type") == F.col("to_type")) & (F.col("from_slug") == F.col("to_slug")))).join(types.select("rel_type"), "rel_type", "left_semi")
    return symmetric(j.select(*RELATION, "rationale", "paper_slug", *(["pos"] if "pos" in drawn.columns else [])), types)


def remove_relation(relations: DataFrame, gone: DataFrame) -> DataFrame:
    return relations.join(gone.select(*RELATION).distinct(), RELATION, "left_anti").select(*relations.columns)


def with_alias(nodes: DataFrame, index: DataFrame, node_type: str, slug: str, alias: str) -> DataFrame:
    """Add a name to a node. The node's own label, or a name of another node, is an error; a name that it has is none."""
    key = label_key(alias)
    me = (F.col("node_type") == node_type) & (F.col("slug") == slug)
    own = nodes.filter(me).select("display_label", "aliases").first()
    if own is None or not key or label_key(own[0]) == key:
        raise ValueError(f"not an alias of {slug!r}: {alias!r}")
    if index.filter((F.col("key") == key) & (F.col("slug") != slug)).limit(1).count():
        raise ValueError(f"taken: {alias!r}")
    if any(label_key(a) == key for a in own[1] or []):
        return nodes
    return nodes.withColumn("aliases", F.when(me, F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), alias)).otherwise(F.col("aliases")))


def without_alias(nodes: DataFrame, node_type: str, slug: str, alias: str) -> DataFrame:
    me = (F.col("node_type") == node_type) & (F.col("slug") == slug)
    return nodes.withColumn("aliases", F.when(me, F.array_remove("aliases", alias)).otherwise(F.col("aliases")))


def renamed(nodes: DataFrame, index: DataFrame, node_type: str, slug: str, label: str) -> DataFrame:
    """A new display label; the slug stays, the old label becomes an alias, an alias equal to the new label goes."""
    key = label_key(label)
    if not key or index.filter((F.col("key") == key) & (F.col("slug") != slug)).limit(1).count():
        raise ValueError(f"blank or taken: {label!r}")
    me = (F.col("node_type") == node_type) & (F.col("slug") == slug)
    rest = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != label)
    aliases = F.when(F.col("display_label") == label, F.col("aliases")).otherwise(F.array_distinct(F.array_append(rest, F.col("display_label"))))
    return nodes.withColumns({"aliases": F.when(me, aliases).otherwise(F.col("aliases")), "display_label": F.when(me, F.lit(label)).otherwise(F.col("display_label"))})


def with_category(nodes: DataFrame, slug: str, category: str, allowed: tuple[str, ...]) -> DataFrame:
    if category not in allowed:
        raise ValueError(f"unknown category: {category!r}")
    me = (F.col("node_type") == "concept") & (F.col("slug") == slug)
    return nodes.withColumn("categories", F.when(me, F.array_union(F.coalesce("categories", F.array().cast("array<string>")), F.array(F.lit(category)))).otherwise(F.col("categories")))


def without_category(nodes: DataFrame, slug: str, category: str) -> DataFrame:
    me = (F.col("node_type") == "concept") & (F.col("slug") == slug)
    return nodes.withColumn("categories", F.when(me, F.array_remove("categories", category)).otherwise(F.col("categories")))


def with_user_notes(nodes: DataFrame, node_type: str, slug: str, text: str) -> DataFrame:
    """Replace the user's notes of a node. A missing node is an error, and so is one that was merged into another."""
    me = (F.col("node_type") == node_type) & (F.col("slug") == slug)
    found = nodes.filter(me).select("redirect_to").first()
    if found is None:
        raise KeyError(f"no such node: {node_type} {slug!r}")
    if found[0]:
        raise ValueError(f"{slug!r} was merged into {found[0]!r}")
    return nodes.withColumn("user_notes", F.when(me, F.lit(text)).otherwise(F.col("user_notes")))


def append_note(notes: Column, more: Column) -> Column:
    """Existing notes without trailing white space, a blank line, the new note."""
    old = F.regexp_replace(F.coalesce(notes, F.lit("")), r"\s+\z", "")
    return F.concat(old, F.lit("\n\n"), more)


def with_label_aliases(nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen``: node_type, slug, label. Labels that papers used become aliases where their key differs from the display label's; aliases are sorted."""
    keyed = seen.join(nodes.select("node_type", "slug", "display_label"), ["node_type", "slug"])
    other = keyed.filter(normalize_label(F.col("label")) != normalize_label(F.col("display_label"))).groupBy("node_type", "slug").agg(F.collect_set("label").alias("more"))
    j = nodes.join(other, ["node_type", "slug"], "left")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "more")))
    return j.withColumn("aliases", F.when(F.col("more").isNotNull(), both).otherwise(F.col("aliases"))).select(*nodes.columns)


def fan_out(mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: node_slug (entity), concept_slug. The mentions that tie an entity to all papers of a concept, or to the concept without a paper where it has none."""
    papers = mentions.filter("node_type = 'concept' and paper_slug is not null").select(F.col("node_slug").alias("concept_slug"), "paper_slug").distinct()
    j = requests.select("node_slug", "concept_slug").distinct().join(papers, "concept_slug", "left")
    return j.select(F.lit("entity").alias("node_type"), "node_slug", "paper_slug", "concept_slug")


def creation_conflicts(requests: DataFrame, nodes: DataFrame, force: bool = False) -> DataFrame:
    """``requests``: label. (label, slug, conflict): "same_slug" always forbids a node, "similar" unless it is forced; null is free to create."""
    from ..functions.text import label_slug
    from .resolve import fuzzy_lookup

    r = requests.select("label", label_slug(normalize_label(F.col("label"))).alias("new")).distinct()
    j = r.join(nodes.select(F.col("slug").alias("new"), F.col("slug").alias("same")), "new", "left")
    j = j.join(fuzzy_lookup(r.select(F.col("label").alias("name")), nodes).withColumnRenamed("name", "label"), "label", "left")
    kind = F.when(F.col("same").isNotNull(), "same_slug")
    kind = kind if force else kind.when(F.col("slug").isNotNull(), "similar")
    return j.select("label", F.coalesce("same", F.lit(None) if force else F.col("slug")).alias("slug"), kind.alias("conflict"))


def with_source_concept(mentions: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: node_slug (entity), paper_slug, concept_slug; one for each entity and paper. Mentions of these get the concept."""
    r = requests.select(F.lit("entity").alias("node_type"), "node_slug", "paper_slug", F.col("concept_slug").alias("__to"))
    j = mentions.join(r, [*NODE, "paper_slug"], "left")
    return j.withColumn("concept_slug", F.coalesce("__to", "concept_slug")).select(*mentions.columns)


def categories_of(category: Column, categories: Column) -> Column:
    """The list of categories, from the single one of older records where there is no list."""
    none = F.array().cast("array<string>")
    return F.coalesce(categories, F.when(F.coalesce(category, F.lit("")) != "", F.array(category)), none)
