"""Connected components of an edge table, by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import freed, stored


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table of their own, so that plans which use them several times don't repeat what made them."""
    return stored(df)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``edges``: (a, b) of any type that sorts; ``nodes``: v. (v, comp), comp the least node that v reaches: a row for each node that has an edge to another, or for all of ``nodes`` if given.

    Large-star and small-star steps alternate, each one shuffle with a pre-aggregated minimum, until the edges stop changing; every second step is written to the shared folder, so that
    a lost executor costs one step, and the one before it is deleted. No group is gathered: a hub's neighbours only meet its minimum through a join that adaptive execution can split.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: every larger neighbour of v, linked to the least of v and its neighbours
        large = both.filter("b > a").join(low, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: v and its smaller neighbours, linked to the least of them
        least = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("v")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = stored(small, "stars")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        freed(e)
        if now == before or now[0] == 0:
            break
        e, before = new, now
    found = new.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionAll(new.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
    if nodes is None:
        return found
    return nodes.select("v").distinct().join(found, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))


def edges_of(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` with the least end first, each once, without loops and null ends."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def extended(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Components (v, comp) after edges have come: these are contracted by the kept table, and only the graph of components that they tie together is solved, so the rounds depend on what is new.
    Nodes that were unknown come in; ``comp`` is still the least node."""
    new = edges_of(added).select("a", "b")
    ends = new.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(kept, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"), F.col("comp").isNull().alias("unknown"))
    ends = stored(ends, "ends")
    side = lambda c: ends.select(F.col("v").alias(c), F.col("comp").alias(f"{c}_comp"))
    tied = new.join(side("a"), "a").join(side("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    into = components(tied).select(F.col("v").alias("comp"), F.col("comp").alias("into"))
    every = kept.select("v", "comp").unionByName(ends.filter("unknown").select("v", "comp"))
    return every.join(into, "comp", "left").select("v", F.coalesce("into", "comp").alias("comp"))


def shrunk(kept: DataFrame, left: DataFrame, removed: DataFrame) -> DataFrame:
    """Components after edges have gone, ``left`` being the edges that stay: the components in which one went are solved again from their own edges, all others stay. Every node stays, alone if need be."""
    ends = removed.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    hit = kept.join(ends, "v", "left_semi").select("comp").distinct()
    again = stored(kept.join(hit, "comp", "left_semi").select("v", "comp"), "again")
    inside = edges_of(left).join(again.select(F.col("v").alias("a")), "a", "left_semi")  # both ends of an edge lie in one component
    return kept.join(hit, "comp", "left_anti").select("v", "comp").unionByName(components(inside, again.select("v")))


def updated(kept: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and edges after a batch: ``removed`` go first, then ``added`` come, so an edge in both is there afterwards.

    ``kept``: (v, comp), a row for each node; ``edges``: all edges so far. Edges are a set without direction. Edges that go without having been there, come again, are loops or have a null end change nothing (an added loop or null end
    brings no node either); a node without edges stays in a component of its own; empty batches leave all as it is.
    """
    e, gone = edges_of(edges), edges_of(removed)
    gone = stored(e.join(gone, ["a", "b"], "left_semi"), "gone")
    left = e.join(gone, ["a", "b"], "left_anti")
    now = stored(left.unionByName(edges_of(added)).distinct(), "edges")
    if gone.limit(1).count():
        kept = stored(shrunk(kept, left, gone), "components")
    return stored(extended(kept, added), "components"), now
