"""Bounded samples of labelled documents, none of them held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def known(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id``, ``y``: labelled ids that aren't held out; of several labels of one id the highest."""
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 0))
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))


def labelled_ids(labels: DataFrame, y: int, most: int, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id``, ``y`` of at most ``most`` rows of one label, those of least hash of the id."""
    return known(labels, id_col, label).filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id``, ``text`` (whole), ``y`` of the documents among ``ids``, a bounded number of them, which is broadcast. Of several rows of one id the least text counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
