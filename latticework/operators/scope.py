"""Containers: brains hold folders and papers, folders hold papers. Transforms return new tables, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(containers: DataFrame) -> DataFrame:
    return containers.orderBy(F.coalesce("created_at", F.lit("")), "id")


def name_taken(containers: DataFrame, name: Column, other_than: str | None = None) -> DataFrame:
    """Containers with the same name but for case and blanks."""
    same = containers.filter(F.lower(F.trim("name")) == F.lower(F.trim(name)))
    return same.filter(F.col("id") != other_than) if other_than else same


def create(containers: DataFrame, id: str, name: str, created_at: str) -> DataFrame:
    """A new folder or brain; a blank or taken name is an error."""
    if not name.strip() or name_taken(containers, F.lit(name)).limit(1).count():
        raise ValueError(f"blank or taken name: {name!r}")
    row = containers.sparkSession.createDataFrame([(id, name.strip(), created_at)], "id string, name string, created_at string")
    return containers.unionByName(row, allowMissingColumns=True)


def rename(containers: DataFrame, id: str, name: str) -> DataFrame:
    must_exist(containers, id)
    if not name.strip() or name_taken(containers, F.lit(name), id).limit(1).count():
        raise ValueError(f"blank or taken name: {name!r}")
    return containers.withColumn("name", F.when(F.col("id") == id, F.lit(name.strip())).otherwise(F.col("name")))


def must_exist(containers: DataFrame, id: str) -> None:
    """A missing container is an error, before anything is changed."""
    if not containers.filter(F.col("id") == id).limit(1).count():
        raise KeyError(f"no such folder or brain: {id!r}")


def delete_folder(folders: DataFrame, members: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
    must_exist(folders, id)
    return folders.filter(F.col("id") != id), members.filter(F.col("folder_id") != id)


def move_paper(members: DataFrame, paper: str, container: str | None, key: str = "folder_id", containers: DataFrame | None = None) -> DataFrame:
    """Take a paper out of all containers of a kind and put it into one, or none. With ``containers`` (id) a missing one is an error."""
    if container is not None and containers is not None:
        must_exist(containers, container)
    rest = members.filter(F.col("paper_slug") != paper)
    if container is None:
        return rest
    return rest.unionByName(members.sparkSession.createDataFrame([(container, paper)], f"{key} string, paper_slug string"), allowMissingColumns=True)


def set_folder_brain(folders: DataFrame, id: str, brain: str | None) -> DataFrame:
    must_exist(folders, id)
    return folders.withColumn("brain_id", F.when(F.col("id") == id, F.lit(brain).cast("string")).otherwise(F.col("brain_id")))


def paper_brain(papers: DataFrame, folders: DataFrame, folder_papers: DataFrame, brain_papers: DataFrame) -> DataFrame:
    """``paper_slug``, ``brain_id``: that of its folder (the first one made, then by id), even if that has none; else its own. A paper in no container has null."""
    made = F.coalesce("created_at", F.lit("")) if "created_at" in folders.columns else F.lit("")
    f = folder_papers.join(folders.select(F.col("id").alias("folder_id"), "brain_id", made.alias("made")), "folder_id")
    f = f.groupBy("paper_slug").agg(F.min(F.struct("made", "folder_id", "brain_id")).alias("f"))
    b = brain_papers.groupBy("paper_slug").agg(F.min("brain_id").alias("direct"))
    j = papers.select(F.col("slug").alias("paper_slug")).join(f, "paper_slug", "left").join(b, "paper_slug", "left")
    return j.select("paper_slug", F.when(F.col("f").isNotNull(), F.col("f.brain_id")).otherwise(F.col("direct")).alias("brain_id"))


def node_brain_ids(mentions: DataFrame, of_paper: DataFrame) -> DataFrame:
    """Sorted distinct brains of each node's papers; the embedding column is never touched."""
    j = mentions.join(of_paper, "paper_slug", "left")
    return j.groupBy("node_type", "node_slug").agg(F.array_sort(F.collect_set("brain_id")).alias("brain_ids"))


def brain_contents(papers: DataFrame, folders: DataFrame, folder_papers: DataFrame, brain_papers: DataFrame) -> DataFrame:
    """``bucket`` (brain or "none"), ``kind``, ``item``: folders by brain, and papers that are in no folder."""
    f = folders.select(F.coalesce("brain_id", F.lit("none")).alias("bucket"), F.lit("folder").alias("kind"), F.col("id").alias("item"))
    direct = brain_papers.groupBy("paper_slug").agg(F.min("brain_id").alias("brain_id"))
    loose = papers.select(F.col("slug").alias("paper_slug")).join(folder_papers, "paper_slug", "left_anti").join(direct, "paper_slug", "left")
    return f.unionByName(loose.select(F.coalesce("brain_id", F.lit("none")).alias("bucket"), F.lit("paper").alias("kind"), F.col("paper_slug").alias("item")))


def merge_brains(folders: DataFrame, brain_papers: DataFrame, survivor: str, loser: str, brains: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Folders and direct papers of the loser go to the survivor; same id is an error. With ``brains`` (id) a missing one is an error too, and the brains without the loser come third."""
    if survivor == loser:
        raise ValueError("a brain can't be merged into itself")
    for id in (survivor, loser) if brains is not None else ():
        must_exist(brains, id)
    to = lambda c: F.when(F.col(c) == loser, F.lit(survivor)).otherwise(F.col(c))
    moved = folders.withColumn("brain_id", to("brain_id")), brain_papers.select(to("brain_id").alias("brain_id"), "paper_slug").distinct()
    return moved if brains is None else (*moved, brains.filter(F.col("id") != loser))


def delete_brain(brains: DataFrame, folders: DataFrame, brain_papers: DataFrame, id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Brains, folders and direct papers without it; a missing one is an error."""
    must_exist(brains, id)
    return brains.filter(F.col("id") != id), folders.withColumn("brain_id", F.nullif("brain_id", F.lit(id))), brain_papers.filter(F.col("brain_id") != id)


def delete_brain_effects(folders: DataFrame, brain_papers: DataFrame, id: str) -> DataFrame:
    """What is set free: ``kind``, ``item``."""
    a = folders.filter(F.col("brain_id") == id).select(F.lit("folder").alias("kind"), F.col("id").alias("item"))
    return a.unionByName(brain_papers.filter(F.col("brain_id") == id).select(F.lit("paper").alias("kind"), F.col("paper_slug").alias("item")))


def affected_papers(folder_papers: DataFrame, folder_ids: list[str]) -> DataFrame:
    """Papers whose scope follows from these folders."""
    return folder_papers.filter(F.col("folder_id").isin(*folder_ids)).select("paper_slug").distinct()


def active_folders(folder_papers: DataFrame, selected: DataFrame) -> DataFrame:
    """Folders that aren't empty and whose papers are all selected (``paper_slug``)."""
    j = folder_papers.join(selected.select("paper_slug", F.lit(True).alias("on")).distinct(), "paper_slug", "left")
    return j.groupBy("folder_id").agg(F.bool_and(F.coalesce("on", F.lit(False))).alias("all_on")).filter("all_on").select("folder_id")


def set_paper_brain(folder_papers: DataFrame, brain_papers: DataFrame, brains: DataFrame, paper: str, brain: str | None) -> tuple[DataFrame, DataFrame, bool]:
    """Put a paper straight into a brain, or none: folder and direct memberships after it, and whether the brain exists. The paper leaves its
    folders even if it doesn't; direct memberships change only if it does."""
    found = brain is None or brains.filter(F.col("id") == brain).limit(1).count() > 0
    out = folder_papers.filter(F.col("paper_slug") != paper)
    return out, move_paper(brain_papers, paper, brain, "brain_id") if found else brain_papers, found


def folder_members(members: DataFrame, papers: DataFrame) -> DataFrame:
    """``members``: folder_id, pos, paper_slug. Papers that exist, in the order of each folder."""
    return members.join(papers.select(F.col("slug").alias("paper_slug"), "title"), "paper_slug").orderBy("folder_id", "pos")


def alphabetical(containers: DataFrame, locale: str = "ko") -> DataFrame:
    """By name in a language's order."""
    return containers.orderBy(F.collate("name", locale), "id")


def with_places(containers: DataFrame, locale: str = "ko") -> DataFrame:
    """``place`` in that order, from 1. Containers are made by hand, so one task numbers them."""
    return containers.withColumn("place", F.row_number().over(Window.orderBy(F.collate("name", locale), "id")).cast("long"))


def toggled(selected: set[str], items: set[str]) -> set[str]:
    """Selected papers after a click on a container: all of its items go if all were selected, else all are added."""
    return selected - items if items and items <= selected else selected | items
