"""Merges of which the survivor of one may be the loser of a later one, as a single batch.

A batch is a forest: each loser hangs on its survivor, and since a node that is merged away takes no part in later merges, what a survivor has in the end is its own content and that of its losers' trees in the order of the
merges. So a node's place is the path of merge numbers from its last survivor down to it, found by pointer doubling (a round for each doubling of the longest chain), and one aggregate by survivor gives what merging one by one gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import freed, stored


def forest(merges: DataFrame) -> DataFrame:
    """``merges``: seq, survivor, loser. (slug, root, path) of each loser and each last survivor, whose path is empty.

    A merge of a node with itself, one that names a node that an earlier one (or one of the same number) has merged away, and one with a null are errors: nothing is merged then. No merges give no rows."""
    m = merges.select("seq", "survivor", "loser")
    lost = m.groupBy(F.col("loser").alias("slug")).agg(F.min("seq").alias("lost"), F.count("*").alias("times"))
    times = m.join(lost.select(F.col("slug").alias("loser"), "times"), "loser", "left").join(lost.select(F.col("slug").alias("survivor"), F.col("lost").alias("survivor_lost")), "survivor", "left")
    bad = F.col("seq").isNull() | F.col("survivor").isNull() | F.col("loser").isNull() | (F.col("survivor") == F.col("loser")) | (F.col("times") > 1) | (F.col("survivor_lost") <= F.col("seq"))
    wrong = times.filter(F.coalesce(bad, F.lit(False))).agg(F.min(F.to_json(F.struct("seq", "survivor", "loser")))).first()[0]
    if wrong is not None:
        raise ValueError(f"a merge that can't be made: {wrong}")
    up = stored(m.select(F.col("loser").alias("slug"), F.col("survivor").alias("root"), F.array("seq").alias("path")), "forest")
    while True:
        above = up.select(F.col("slug").alias("root"), F.col("root").alias("further"), F.col("path").alias("above"))
        j = up.join(above, "root", "left")
        new = stored(j.select("slug", F.coalesce("further", "root").alias("root"), F.when(F.col("above").isNotNull(), F.concat("above", "path")).otherwise(F.col("path")).alias("path"), F.col("further").isNotNull().alias("moved")), "forest")
        freed(up)
        up = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            break
    roots = up.select(F.col("root").alias("slug"), "root").distinct().withColumn("path", F.array().cast(up.schema["path"].dataType))
    return up.unionByName(roots)


def merge_mentions(mentions: DataFrame, tree: DataFrame) -> DataFrame:
    """Mentions after the merges (``tree``: of ``forest``): those of losers go to the last survivor unless a node before theirs has the paper (a missing paper equals a missing paper).
    ``ord`` becomes the place among the survivor's, from 0; mentions of nodes outside the merges stay as they are."""
    t = tree.select(F.col("slug").alias("node_slug"), "root", "path")
    m = mentions if "ord" in mentions.columns else mentions.withColumn("ord", F.lit(0))
    mine = m.join(t, "node_slug")
    first = mine.groupBy("root", "paper_slug").agg(F.min("path").alias("first")).select(F.col("root").alias("r"), F.col("paper_slug").alias("p"), "first")
    kept = mine.join(first, (mine["root"] == first["r"]) & mine["paper_slug"].eqNullSafe(first["p"])).filter("path = first")
    rest = [c for c in m.columns if c not in ("node_slug", "ord")]
    place = F.row_number().over(Window.partitionBy("root").orderBy("path", "ord", *rest)) - 1
    moved = kept.withColumn("ord", place.cast(m.schema["ord"].dataType)).withColumn("node_slug", F.col("root"))
    return m.join(t, "node_slug", "left_anti").select(*m.columns).unionByName(moved.select(*m.columns))


def merge_nodes(nodes: DataFrame, tree: DataFrame, merged_at: str) -> DataFrame:
    """Nodes after the merges: last survivors get the sorted aliases and labels, the slugs and the notes of all that went into them, notes with a divider each; every loser redirects to its last survivor, keeping its other columns.
    Nodes outside the merges stay as they are, slugs that no node has are left out, blank notes add nothing."""
    none = F.array().cast("array<string>")
    x = nodes.join(tree, "slug").select("root", "path", "slug", "display_label", F.coalesce("aliases", none).alias("aliases"), F.coalesce("merged_from", none).alias("merged_from"), F.coalesce("user_notes", F.lit("")).alias("note"))
    # a loser's notes count if any of its tree says something: the next node that does, in order, then hangs below it
    says = F.when(F.trim("note") != "", F.col("path"))
    following = F.first(says, ignorenulls=True).over(Window.partitionBy("root").orderBy("path").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    x = x.withColumn("next", following)
    below = F.coalesce(F.slice("next", 1, F.size("path")) == F.col("path"), F.lit(False))
    is_loser = F.size("path") > 0
    divided = F.when(~is_loser, F.col("note")).when(below, F.concat(F.lit(f"\n\n--- merged {merged_at[:10]} ---\n\n"), "note")).otherwise("")
    names = F.when(is_loser, F.concat("aliases", F.array("display_label"))).otherwise(F.col("aliases"))
    slugs = F.when(is_loser, F.concat(F.array("slug"), "merged_from"))
    part = F.struct("path", names.alias("names"), F.coalesce(slugs, none).alias("slugs"), divided.alias("note"))
    g = x.groupBy(F.col("root").alias("slug")).agg(F.array_sort(F.collect_list(part)).alias("parts"), F.count_if(is_loser).alias("losers"))
    g = g.filter("losers > 0").select(
        "slug", F.array_sort(F.array_distinct(F.flatten("parts.names"))).alias("__names"), F.flatten("parts.slugs").alias("__slugs"), F.array_join("parts.note", "").alias("__notes"),
    )
    to = tree.filter(F.size("path") > 0).select("slug", F.col("root").alias("__to"))
    j = nodes.join(g, "slug", "left").join(to, "slug", "left")
    hit = F.col("__names").isNotNull()
    return j.withColumns({
        "aliases": F.when(hit, F.col("__names")).otherwise(F.col("aliases")),
        "merged_from": F.when(hit, F.concat(F.coalesce("merged_from", none), "__slugs")).otherwise(F.col("merged_from")),
        "user_notes": F.when(hit & (F.col("__notes") != ""), F.col("__notes")).otherwise(F.col("user_notes")),
        "redirect_to": F.coalesce("__to", "redirect_to"),
    }).select(*nodes.columns)
