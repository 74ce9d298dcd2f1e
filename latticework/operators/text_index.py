"""A full-text index: postings in blocks with maxima, in segments, and BM25 that skips blocks which can't win.

Documents are dealt to ranges by the hash of their id, about ``SPAN`` to a range. A block holds the postings of one term in one range: ids, counts, lengths, beside the number of postings, the greatest count and the least length, which bound
the score of the term in the range. Blocks of a segment lie in folders by the hash of their term, sorted by term and range, so a search reads the folders of the terms that are asked for, of them first the short columns: they give the
document frequencies and, added up over the terms, what a document of a range can score at most. The ranges of highest bound are scored first; then only those whose bound reaches the k-th score. The result equals that of a full scan.

A block holds the documents of one range at most, so a term that stands in every document makes many blocks, never a large one. ``insert`` adds a segment; ``merged`` makes one segment of all. The manifest is one file
per state, put in place by a rename, so readers see whole states.

Edge cases: null texts count as empty and have no postings, but count as documents; a query without words finds nothing; ids must differ over all segments; a null id lies in a range like others.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import get, listed, put_new
from ..storage import stored
from .search import B, K1, TOP_K, terms, top

SPAN, BUCKETS, FIRST = 1024, 32, 8


@dataclass
class TextIndex:
    spark: SparkSession
    root: str
    number: int
    state: dict  # ranges, buckets, id type, segments: folder, docs, words

    def blocks(self, words: list[str]) -> DataFrame:
        """Blocks of the words, from their folders only."""
        made = [F.pmod(F.xxhash64(F.lit(w)), F.lit(self.state["buckets"])) for w in words]
        folders = set(self.spark.range(1).select(F.array(*made)).first()[0])
        found = None
        for i, seg in enumerate(self.state["segments"]):
            rows = self.spark.read.parquet(f"{self.root}/{seg['folder']}").filter(F.col("bucket").isin(*folders) & F.col("term").isin(*words)).withColumn("seg", F.lit(i))
            found = rows if found is None else found.unionByName(rows)
        return found

    def commit(self, segments: list[dict]) -> TextIndex:
        state = {**self.state, "segments": segments}
        put_new(self.spark, f"{self.root}/states/{self.number + 1:012}.json", json.dumps(state))
        return TextIndex(self.spark, self.root, self.number + 1, state)

    def write(self, postings: DataFrame) -> str:
        """A folder of blocks. ``postings``: term, range, id, tf, len."""
        grouped = postings.groupBy("term", "range").agg(F.array_sort(F.collect_list(F.struct("id", "tf", "len"))).alias("p"))
        rows = grouped.select(
            "term", "range", F.size("p").alias("n"), F.array_max("p.tf").alias("most"), F.array_min("p.len").alias("least"), "p", F.pmod(F.xxhash64("term"), F.lit(self.state["buckets"])).cast("int").alias("bucket")
        )
        folder = f"segment-{uuid.uuid4().hex}"
        # a bucket's rows go to as many tasks as their size asks for
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def insert(self, docs: DataFrame, id_col: str = "id", text: str = "text") -> TextIndex:
        """One more segment."""
        rows = docs.select(F.col(id_col).cast(self.state["id"]).alias("id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        total = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
        span = F.pmod(F.xxhash64("id"), F.lit(self.state["ranges"]))
        words = rows.select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
        postings = words.groupBy("term", "id", "len").agg(F.count("*").cast("int").alias("tf")).withColumn("range", span)
        return self.commit([*self.state["segments"], {"folder": self.write(postings), "docs": total[0], "words": total[1]}])

    def merged(self) -> TextIndex:
        """All segments as one; readers of the states before keep theirs."""
        every = None
        for seg in self.state["segments"]:
            rows = self.spark.read.parquet(f"{self.root}/{seg['folder']}").select("term", "range", F.inline("p"))
            every = rows if every is None else every.unionByName(rows)
        if every is None:
            return self
        add = lambda c: sum(s[c] for s in self.state["segments"])
        return self.commit([{"folder": self.write(every), "docs": add("docs"), "words": add("words")}])


def built(docs: DataFrame, root: str, id_col: str = "id", text: str = "text", buckets: int = BUCKETS, span: int = SPAN) -> TextIndex:
    """A new index; the number of ranges follows from the documents there are."""
    n = docs.count()
    empty = TextIndex(docs.sparkSession, root, 0, {"ranges": max(1, n // span), "buckets": buckets, "id": docs.schema[id_col].dataType.simpleString(), "segments": []})
    return empty.insert(docs, id_col, text)


def opened(spark: SparkSession, root: str) -> TextIndex:
    """The newest state."""
    number = max(int(n.split(".")[0]) for n in listed(spark, f"{root}/states") if not n.startswith("."))
    return TextIndex(spark, root, number, json.loads(get(spark, f"{root}/states/{number:012}.json")))


def part(tf: Column, length: Column, idf: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def bounds(index: TextIndex, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """(term, idf), and (seg, range, bound) of the ranges that have a word: from the short columns alone."""
    n_docs, n_words = (sum(s[c] for s in index.state["segments"]) for c in ("docs", "words"))
    average = float(max(n_words, 1) / max(n_docs, 1))
    heads = stored(index.blocks(words).select("seg", "term", "range", "n", "most", "least"), "heads")
    df = heads.groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # a row for each word
    most = heads.join(F.broadcast(idf), "term").withColumn("b", part(F.col("most").cast("double"), F.col("least"), F.col("idf"), average))
    return idf, most.groupBy("seg", "range").agg(F.sum("b").alias("bound"))


def search(index: TextIndex, query: str, k: int = TOP_K, first: int = FIRST) -> DataFrame:
    """``id``, ``score``, ``rank`` of the k best documents, as ``search.bm25`` gives them. ``first`` ranges are scored before the bar is known; any number is right."""
    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    if not words or not index.state["segments"]:
        return index.spark.createDataFrame([], f"id {index.state['id']}, score double, rank long")
    n_docs, n_words = (sum(s[c] for s in index.state["segments"]) for c in ("docs", "words"))
    average = float(max(n_words, 1) / max(n_docs, 1))
    idf, ranges = bounds(index, words)
    ranges = stored(ranges, "ranges")

    def scored(some: DataFrame) -> DataFrame:
        rows = index.blocks(words).select("seg", "range", "term", "p").join(some.select("seg", "range"), ["seg", "range"]).select("term", F.inline("p"))
        each = rows.join(F.broadcast(idf), "term").withColumn("s", part(F.col("tf").cast("double"), F.col("len"), F.col("idf"), average))
        return each.groupBy("id").agg(F.round(F.sum("s"), 6).alias("score"))

    head = stored(ranges.orderBy(F.desc("bound"), "seg", "range").limit(first), "head")
    best = stored(top(scored(F.broadcast(head)), k, F.desc("score"), F.col("id")).drop("rank"), "best")
    bar = best.agg(F.when(F.count("*") >= k, F.min("score"))).first()[0]
    rest = ranges.join(F.broadcast(head.select("seg", "range")), ["seg", "range"], "left_anti")
    if bar is not None:
        rest = rest.filter(F.col("bound") >= bar - 1e-6)
    return top(best.unionByName(scored(rest)), k, F.desc("score"), F.col("id"))


def share_read(index: TextIndex, query: str, k: int = TOP_K, first: int = FIRST) -> tuple[int, int, int]:
    """Blocks of the words whose postings a search reads, blocks of the words, and all blocks."""
    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    _, ranges = bounds(index, words)
    ranges = stored(ranges, "ranges")
    found = search(index, query, k, first)
    bar = found.agg(F.when(F.count("*") >= k, F.min("score"))).first()[0]
    head = ranges.orderBy(F.desc("bound"), "seg", "range").limit(first)
    read = ranges.filter(F.col("bound") >= (bar if bar is not None else 0.0) - 1e-6).unionByName(head).distinct()
    mine = index.blocks(words).select("seg", "range", "term")
    every = sum(index.spark.read.parquet(f"{index.root}/{s['folder']}").count() for s in index.state["segments"])
    return mine.join(read.select("seg", "range").distinct(), ["seg", "range"]).count(), mine.count(), every
