"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classify, decontaminate, html, periodic, quality, repair, secrets, similar, substrings, token_counts, warc
from .common import small_batches


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session whose Arrow batches suit whole texts."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_warc": warc.op3_warc,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_html_text": html.op7_html_text,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_classifier": classify.op9_quality_classifier,
    "op10_jaccard_join": similar.op10_jaccard_join,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_token_counts": token_counts.op13_token_counts,
}
QUERIES = {name: prepared(query) for name, query in QUERIES.items()}
ORACLE_SQL = {"op2_decontaminate": decontaminate.SQL, "op3_warc": warc.SQL, "op6_chat_format": chat.SQL, "op11_conversation_repair": repair.SQL}
