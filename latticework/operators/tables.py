"""Small table operators: point lookups, filters, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.select(F.lit(node_type).alias("node_type"), "slug", "display_label")


def live(nodes: DataFrame) -> DataFrame:
    """Nodes with a slug that aren't redirects."""
    return nodes.filter((F.coalesce("slug", F.lit("")) != "") & F.col("redirect_to").isNull())


def get_node(nodes: DataFrame, node_type: str, slug: str) -> DataFrame:
    return live(nodes).filter((F.col("node_type") == node_type) & (F.col("slug") == slug))


def display_label(nodes: DataFrame, node_type: str, slug: str) -> DataFrame:
    """A row with the label, or the slug where there is none."""
    return get_node(nodes, node_type, slug).select(F.coalesce(F.nullif("display_label", F.lit("")), "slug").alias("display_label"))


def section(content: Column, start: str, end: str | None = None) -> Column:
    """Text after a marker and before another; empty without the first."""
    after = F.when(F.instr(content, start) > 0, F.substring(content, F.instr(content, start) + len(start), F.length(content))).otherwise("")
    return F.trim(F.substring_index(after, end, 1) if end else after)


def paper_titles(papers: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` slugs with the title of their note, or the slug."""
    return listed.select("slug").join(papers.select("slug", "title"), "slug", "left").select("slug", F.coalesce(F.nullif("title", F.lit("")), "slug").alias("title"))


def nodes_of_paper(mentions: DataFrame, paper: Column) -> DataFrame:
    return mentions.filter(F.col("paper_slug") == paper).select("node_type", "node_slug").distinct()


def concepts_of_papers(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(paper_slug, slug, display_label) of the concepts that papers mention."""
    m = mentions.filter("node_type = 'concept'").select("paper_slug", F.col("node_slug").alias("slug")).distinct()
    return m.join(concepts.select("slug", "display_label"), "slug").select("paper_slug", "slug", "display_label")


def entities_of_concepts(mentions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_slug, node_slug) of the entities that hang on live concepts."""
    m = mentions.filter("node_type = 'entity'").join(concepts.select(F.col("slug").alias("concept_slug")), "concept_slug", "left_semi")
    return m.select("concept_slug", "node_slug").distinct()


def relations_of(relations: DataFrame, node_type: str, slug: str) -> DataFrame:
    return relations.filter((F.col("from_type") == node_type) & (F.col("from_slug") == slug))


def known_relations(relations: DataFrame, types: DataFrame) -> DataFrame:
    """Relations of a type in the vocabulary between concepts and entities. The vocabulary is a dimension of a dozen rows; a larger one is joined by Spark's own choice."""
    ends = F.col("from_type").isin("concept", "entity") & F.col("to_type").isin("concept", "entity")
    return relations.filter(ends).join(types.select("rel_type"), "rel_type", "left_semi")


def described(types: DataFrame, descriptions: DataFrame) -> DataFrame:
    return types.select("rel_type").join(descriptions, "rel_type", "left").select("rel_type", F.coalesce("description", "rel_type").alias("description"))


def candidates(queue: DataFrame, status: str = "pending") -> DataFrame:
    return queue.filter(F.coalesce("status", F.lit("pending")) == status)


def label_search(nodes: DataFrame, text: str, hidden: tuple[str, ...] = (), limit: int | None = 12) -> DataFrame:
    """Nodes whose label contains a text, whatever the case. The limit is what the search box shows."""
    found = nodes.filter(F.lower("label").contains(text.strip().lower()) & ~F.col("type").isin(*hidden) if hidden else F.lower("label").contains(text.strip().lower()))
    return found.orderBy("label", "id").limit(limit) if limit else found


def nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """The node next to a point; the smallest id of several."""
    far = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.agg(F.min(F.struct(far.alias("d"), F.col("id"))).alias("m")).select(F.col("m.id").alias("id"), F.col("m.d").alias("distance"))


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call: tokens by price per million; cache writes 1.25 times and cache reads a tenth of the input price. An unknown model stops the job."""
    per = lambda c: F.col(c) / F.lit(1_000_000)
    j = usage.join(prices, "model", "left")
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.col("model")))
    tokens = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = (
        tokens("input_tokens") * per("input_price")
        + tokens("output_tokens") * per("output_price")
        + tokens("cache_write_tokens") * per("input_price") * 1.25
        + tokens("cache_read_tokens") * per("input_price") * 0.1
    )
    return j.withColumn("cost", F.when(F.col("input_price").isNull(), unknown.cast("double")).otherwise(total)).select(*usage.columns, "cost")
