"""The corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, secrets, tokens.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame that is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``, extra ones with clashing names among them.

Edge cases, the same for every stage: an empty table gives an empty result with the stage's columns; a null text counts as empty, and stays null where the
document stays; a very long text is taken whole.

* quality rules: null and empty texts go (fewer than 50 words); repeated rows and rows with null ids are judged one by one.
* one of each: null, empty and wordless texts link with nothing and stay; of several rows with one id the one with the shortest text stays; rows with a null id all stay; of a group that
  links, the least id stays.
* benchmark: documents without hits stay as they are, null ones too; test items without words hit nothing.
* secrets: every row stays; null texts stay null.
* tokens: a row for each row; a null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import bpe, decontaminate, quality, secrets, similar
from latticework.llm.common import small_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def prepared(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches suit whole texts."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


def counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@prepared
def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the compression bands are learnt from labelled documents."""
    return quality.keep_good(docs, bands=quality.fitted(docs, table(spark, sf_dir, "labels")))


@prepared
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays."""
    return similar.one_of_each(docs)


@prepared
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


@prepared
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to placeholders."""
    return counted(secrets.redact(docs))


@prepared
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe_tokens", encode_tokens),
]

#: SQL can express neither zstandard ratios nor merges by rank; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
