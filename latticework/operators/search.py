"""Hybrid retrieval: exact vector search, BM25, reciprocal rank fusion, and expansion over the graph, as one plan without a loop over seeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine
from ..storage import stored

# Rank constant, hits, neighbours for each hit, routed relation types.
RRF_K = 60
TOP_K = 10
NEIGHBOR_CAP = 5
ROUTED_TYPES = 3
#: BM25 parameters.
K1, B = 1.2, 0.75


def top(rows: DataFrame, k: int, *order: Column, by: str | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows in an order, for each value of ``by`` or in all, with their rank. Without ``by`` the k rows are taken by a distributed top-k and only then ranked."""
    if by is None:
        rows = rows.orderBy(*order).limit(k)
    w = Window.partitionBy(by if by else F.lit(0)).orderBy(*order)
    # the filter stands right above the window, so that Spark cuts each group to k rows before it shuffles
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def vector_hits(vectors: DataFrame, query: DataFrame, k: int = TOP_K) -> DataFrame:
    """``vectors``: node_type, node_slug, embedding; ``query``: one row, q. The k nearest of each node type, ranked together by score. Exact: every vector is scored where it
    lies, and only k rows a partition and type move."""
    scored = vectors.join(F.broadcast(query.limit(1))).select("node_type", "node_slug", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    order = [F.desc("score"), F.col("node_slug")]
    best = top(scored, k, *order, by="node_type", rank="n").drop("n")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "node_type", "node_slug")  # at most k rows for each type
    return best.withColumn("rank", F.row_number().over(w).cast("long"))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def bm25(docs: DataFrame, query: str, k: int | None = TOP_K, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id``, ``score`` of documents with a word of the query; a query without words finds none. One pass over the texts: each row keeps its length and the counts of the query's words; these short rows
    are written down, and what the formula needs of all documents is added up from them."""
    asked = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    if not asked:
        none = docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).filter("false")
        return none.withColumn("rank", F.lit(0).cast("long")) if k else none
    t = terms(F.coalesce(F.col(text), F.lit("")))
    # the words of the query are picked out of the text once, then counted
    mine = F.filter("t", lambda x: x.isin(*asked))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t")).select("id", F.size("t").alias("len"), mine.alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    rows = stored(rows.select("id", "len", *(count(w).alias(f"n{i}") for i, w in enumerate(asked))), "postings")
    total = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(asked))))
    j = rows.filter(F.greatest(*(F.col(f"n{i}") for i in range(len(asked))), F.lit(0)) > 0).join(F.broadcast(total))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"n{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))

    score = F.lit(0.0)
    for i in range(len(asked)):
        score = score + F.when(F.col(f"n{i}") > 0, part(i)).otherwise(0.0)
    scored = j.select("id", F.round(score, 6).alias("score"))
    return top(scored, k, F.desc("score"), F.col("id")) if k else scored


def fuse(*lists: DataFrame, k: int = TOP_K, keys: tuple[str, ...] = ("node_type", "node_slug")) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (keys, rank)."""
    rows = lists[0].select(*keys, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select(*keys, "rank"))
    fused = rows.groupBy(*keys).agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top(fused, k, F.desc("score"), *(F.col(c) for c in keys))


def route(types: DataFrame, query: DataFrame, n: int = ROUTED_TYPES) -> DataFrame:
    """``types``: rel_type, embedding (a dozen rows). The n types nearest to the query, weighted by cosine (negative too)."""
    scored = types.join(F.broadcast(query.limit(1))).select("rel_type", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("type_score"))
    return top(scored, n, F.desc("type_score"), F.col("rel_type")).drop("rank")


def listed_types(given: str | list[str] | None) -> list[str]:
    """Names of types from a list, or from a text with commas; blanks around them and empty ones don't count."""
    parts = given.split(",") if isinstance(given, str) else given or []
    return [p.strip() for p in parts if p.strip()]


def explicit_types(given: str | list[str], types: DataFrame) -> DataFrame:
    """Types asked for, weight 1; unknown ones are dropped, even if none is left."""
    given = listed_types(given)
    return types.filter(F.col("rel_type").isin(*given)).select("rel_type", F.lit(1.0).alias("type_score"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``edges``: src_type, src_slug, dst_type, dst_slug, relation (null for provenance). Each one from either end: seed, neighbour, relation, direction."""
    a = edges.select(F.col("src_type").alias("seed_type"), F.col("src_slug").alias("seed_slug"), F.col("dst_type").alias("node_type"), F.col("dst_slug").alias("node_slug"), "relation", F.when(F.col("relation").isNotNull(), "outgoing").alias("direction"))
    b = edges.select(F.col("dst_type").alias("seed_type"), F.col("dst_slug").alias("seed_slug"), F.col("src_type").alias("node_type"), F.col("src_slug").alias("node_slug"), "relation", F.when(F.col("relation").isNotNull(), "incoming").alias("direction"))
    return a.unionByName(b)


def neighbors_all(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``seeds``: seed_type, seed_slug. Every incident edge of every seed; several edges to one neighbour are several rows."""
    return both_ways(edges).join(seeds.select("seed_type", "seed_slug"), ["seed_type", "seed_slug"])


def provenance_neighbors(seeds: DataFrame, edges: DataFrame, brain: str | None = None, brain_ids: DataFrame | None = None) -> DataFrame:
    """All neighbours by provenance, in the brain if one is given: seed_type, seed_slug, node_type, node_slug."""
    around = neighbors_all(seeds, edges.filter("relation is null"))
    return scoped(around, brain_ids, brain).select("seed_type", "seed_slug", "node_type", "node_slug")


def neighbors_routed(seeds: DataFrame, edges: DataFrame, routed: DataFrame, vectors: DataFrame, query: DataFrame, cap: int = NEIGHBOR_CAP, brain: str | None = None, brain_ids: DataFrame | None = None) -> DataFrame:
    """Semantic neighbours by routed types, in the brain if one is given, scored by type weight and likeness to the query (0 without a vector), rounded, then the best ``cap`` of each seed.
    ``total`` is how many there were."""
    semantic = both_ways(edges.filter("relation is not null")).join(seeds.select("seed_type", "seed_slug"), ["seed_type", "seed_slug"])
    semantic = scoped(semantic, brain_ids, brain)
    j = semantic.join(routed.withColumnRenamed("rel_type", "relation"), "relation").join(vectors, ["node_type", "node_slug"], "left").join(F.broadcast(query.limit(1)))
    scored = j.withColumn("score", F.bround(F.col("type_score") * cosine(F.col("embedding"), F.col("q")), 4))
    w = Window.partitionBy("seed_type", "seed_slug")
    order = w.orderBy(F.desc("score"), "node_type", "node_slug", "relation", "direction")
    ranked = scored.withColumns({"total": F.count("*").over(w), "n": F.row_number().over(order)}).filter(F.col("n") <= max(1, cap))
    return ranked.select("seed_type", "seed_slug", "node_type", "node_slug", "relation", "direction", "score", "total", F.col("n").cast("long").alias("n"))


def second_hop(first: DataFrame, edges: DataFrame, routed: DataFrame, vectors: DataFrame, query: DataFrame, hop2: int, cap: int = NEIGHBOR_CAP, brain: str | None = None, brain_ids: DataFrame | None = None) -> DataFrame:
    """Neighbours of the first ``hop2`` neighbours of each seed, with ``via``; the seed itself may come back."""
    via = first.filter(F.col("n") <= max(0, hop2)).select("seed_type", "seed_slug", F.col("node_type").alias("via_type"), F.col("node_slug").alias("via_slug"))
    mids = via.select(F.col("via_type").alias("seed_type"), F.col("via_slug").alias("seed_slug")).distinct()
    far = neighbors_routed(mids, edges, routed, vectors, query, cap, brain, brain_ids)
    far = far.select(F.col("seed_type").alias("via_type"), F.col("seed_slug").alias("via_slug"), "node_type", "node_slug", "relation", "direction", "score")
    return via.distinct().join(far, ["via_type", "via_slug"])


def scoped(rows: DataFrame, brain_ids: DataFrame, brain: str | None) -> DataFrame:
    """Rows of nodes in a brain. Applied to vector hits after their top-k, to text hits before."""
    if brain is None:
        return rows
    inside = brain_ids.filter(F.array_contains("brain_ids", brain)).select("node_type", "node_slug")
    return rows.join(inside, ["node_type", "node_slug"], "left_semi")


def hybrid(vectors: DataFrame, query: DataFrame, docs: DataFrame, text: str, k: int = TOP_K, brain_ids: DataFrame | None = None, brain: str | None = None) -> DataFrame:
    """``docs``: node_type, node_slug, text. Fused hits of both rankings."""
    v = vector_hits(vectors, query, k)
    d = docs
    if brain is not None:
        v = scoped(v, brain_ids, brain)
        # ranks close up after the filter
        v = v.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank")))
        d = scoped(d, brain_ids, brain)
    t = bm25(d.withColumn("id", F.struct("node_type", "node_slug")), text, k).select("id.node_type", "id.node_slug", "rank")
    return fuse(v, t, k=k)


def node_text(label: Column, aliases: Column, description: Column, note: Column) -> Column:
    """What a node is embedded by: its label, aliases, description and note, one a line, without empty ones."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", some(label), some(F.array_join(aliases, ", ")), some(description), some(note))


def index_text(label: Column, description: Column, note: Column, user_notes: Column) -> Column:
    """What the full-text index holds of a node."""
    return F.concat_ws("\n", label, description, note, user_notes)


def nested(hits: DataFrame, neighbors: DataFrame, name: str = "neighbors") -> DataFrame:
    """One row for each hit, its neighbours in an array; null where it has none."""
    n = neighbors.groupBy("seed_type", "seed_slug").agg(F.array_sort(F.collect_list(F.struct(*[c for c in neighbors.columns if not c.startswith("seed_")]))).alias(name))
    j = hits.join(n.select(F.col("seed_type").alias("node_type"), F.col("seed_slug").alias("node_slug"), name), ["node_type", "node_slug"], "left")
    return j


def search(
    text: str, query: DataFrame, vectors: DataFrame, docs: DataFrame, edges: DataFrame, types: DataFrame, *, mode: str = "all", k: int = TOP_K,
    relation_types: str | list[str] | None = None, cap: int = NEIGHBOR_CAP, hop2: int = 0, brain: str | None = None, brain_ids: DataFrame | None = None,
) -> DataFrame:
    """Fused hits with their surroundings. ``all``: every incident edge (``neighbors``). ``routed``: all neighbours by ``provenance``, the best semantic ``neighbors`` by routed or given
    relation types, how many there were (``total``), a ``second`` hop if asked for, and the ``routed_types``. ``types``: rel_type, embedding; ``brain_ids``: node_type, node_slug,
    brain_ids of concepts, entities and papers (a paper's own brain as a list of one). A brain scopes hits, neighbours and the second hop."""
    hits = hybrid(vectors, query, docs, text, k, brain_ids, brain)
    seeds = hits.select(F.col("node_type").alias("seed_type"), F.col("node_slug").alias("seed_slug"))
    if mode == "all":
        around = neighbors_all(seeds, edges)
        if brain is not None:
            around = scoped(around, brain_ids, brain)
        return nested(hits, around)
    routed = explicit_types(relation_types, types) if listed_types(relation_types) else route(types, query)
    first = neighbors_routed(seeds, edges, routed, vectors, query, cap, brain, brain_ids)
    out = nested(hits, first)
    out = out.withColumn("total", F.coalesce(F.col("neighbors")[0]["total"], F.lit(0)))
    out = nested(out, provenance_neighbors(seeds, edges, brain, brain_ids), "provenance")
    if hop2 > 0:
        out = nested(out, second_hop(first, edges, routed, vectors, query, hop2, cap, brain, brain_ids), "second")
    names = routed.agg(F.array_sort(F.collect_list("rel_type")).alias("routed_types"))  # one row of a dozen names at most
    return out.join(F.broadcast(names))
