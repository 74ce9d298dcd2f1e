"""Substring search in labels by trigrams, for many texts at once; equal to ``tables.label_search`` of each.

The postings have a row for each label and each of its distinct pieces of three characters (the last two places give pieces of two and one), with the label beside it so that a hit is verified where it is read. A dictionary counts the rows of each piece.
A text of three characters or more reads the postings of its rarest piece; a shorter one is the beginning of the pieces at each place where it stands, so it reads those that begin with it. Postings lie in buckets by piece, the dictionary in
buckets by first character; a search reads the buckets of what it asks for. Later labels come as segments; the dictionary's counts are added up.

Edge cases: texts are taken without white space at their ends and in lower case; a null text and a null label match nothing; an empty text matches every label, and reads all; repeated rows of a node count each; a text that no label has gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POSTINGS = "gram string, id string, label string, type string, bucket int"
DICTIONARY = "gram string, n long, bucket int"


@dataclass(frozen=True)
class LabelIndex:
    spark: SparkSession
    path: str
    buckets: int
    segments: int = 0

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def insert(self, nodes: DataFrame) -> LabelIndex:
        """The index with more nodes (id, label, type), as a segment of its own."""
        low = F.lower("label")
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
        rows = nodes.filter("label is not null").select("id", "label", "type", F.explode(pieces).alias("gram")).withColumn("bucket", self.bucket(F.col("gram")))
        place = f"{self.path}/segment={self.segments}"
        rows.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{place}/postings")
        counted = self.spark.read.schema(POSTINGS).parquet(f"{place}/postings").groupBy("gram").agg(F.count("*").alias("n"))
        counted.withColumn("bucket", self.bucket(F.substring("gram", 1, 1))).hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{place}/dictionary")
        return replace(self, segments=self.segments + 1)

    def read(self, name: str, kind: str, buckets: list[int] | None) -> DataFrame:
        """Some buckets of all segments, or all."""
        some = None
        for i in range(self.segments):
            one = self.spark.read.schema(kind).parquet(f"{self.path}/segment={i}/{name}")
            some = one if some is None else some.unionByName(one)
        if some is None:
            return self.spark.createDataFrame([], kind)
        return some if buckets is None else some.filter(F.col("bucket").isin(*buckets)) if buckets else some.limit(0)

    def asked(self, keys: DataFrame) -> list[int]:
        """Buckets of keys, as many numbers at most as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())


def built(nodes: DataFrame, path: str, buckets: int = 64) -> LabelIndex:
    """The index of nodes, in a new folder."""
    return LabelIndex(nodes.sparkSession, path, buckets).insert(nodes)


def cleaned(texts: DataFrame) -> DataFrame:
    text = F.lower(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return texts.select("qid", text.alias("text")).filter("text is not null").distinct()


def grams(index: LabelIndex, texts: DataFrame) -> DataFrame:
    """(qid, text, gram, n): the pieces whose postings a text reads."""
    long = texts.filter(F.length("text") >= 3)
    pieces = F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring("text", i, F.lit(3)))
    of_long = long.select("qid", "text", F.explode(F.array_distinct(pieces)).alias("gram"))
    short = texts.filter(F.length("text") < 3)
    everything = short.filter("text = ''").limit(1).count() > 0
    firsts = of_long.select(F.substring("gram", 1, 1).alias("c")).unionAll(short.select(F.substring("text", 1, 1))).distinct()
    known = index.read("dictionary", DICTIONARY, None if everything else index.asked(firsts)).groupBy("gram").agg(F.sum("n").alias("n"))
    # a text with a piece that no label has is found nowhere: it keeps count 0 and meets no postings
    counted = of_long.join(known, "gram", "left").select("qid", "text", F.struct(F.coalesce("n", F.lit(0)).cast("long").alias("n"), "gram").alias("x"))
    rarest = counted.groupBy("qid", "text").agg(F.min("x").alias("x")).select("qid", "text", F.col("x.gram").alias("gram"), F.col("x.n").alias("n")).filter("n > 0")
    # pieces by their beginnings of no, one and two characters, so that short texts meet them by an equi-join
    begins = known.select("gram", "n", F.explode(F.array_distinct(F.array(F.lit(""), F.substring("gram", 1, 1), F.substring("gram", 1, 2)))).alias("text"))
    return rarest.unionByName(short.join(begins, "text").select("qid", "text", "gram", "n"))


def search(index: LabelIndex, texts: DataFrame, hidden: tuple[str, ...] = (), limit: int | None = 12) -> DataFrame:
    """``texts``: qid, text. ``qid``, ``id``, ``label``, ``type`` of the nodes whose label contains the text; the ``limit`` first of each by label and id, which is what a search box shows, with their ``place``; all if None."""
    asked = cleaned(texts)
    # a text that many ask for is looked up once
    wanted = grams(index, asked.select(F.col("text").alias("qid"), "text").distinct())
    rows = index.read("postings", POSTINGS, index.asked(wanted.select("gram")))
    if hidden:
        rows = rows.filter(~F.col("type").isin(*hidden))
    # a label meets a short text once for each piece that begins with it: how often the row is there shows in the piece that it has most often
    hits = rows.join(wanted.select("text", "gram"), "gram").filter(F.contains(F.lower("label"), F.col("text")))
    per = hits.groupBy("text", "id", "label", "type", "gram").agg(F.count("*").alias("times")).groupBy("text", "id", "label", "type").agg(F.max("times").alias("times"))
    found = per.select("text", "id", "label", "type", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")).drop("copy")
    if limit:
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("text").orderBy("label", "id"))).filter(F.col("place") <= limit)
    return asked.join(found, "text").drop("text")


def rows_read(index: LabelIndex, texts: DataFrame) -> tuple[int, int]:
    """Postings of the pieces that texts ask for, and all postings."""
    wanted = grams(index, cleaned(texts)).select("gram", "n").distinct()
    return wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], index.read("postings", POSTINGS, None).count()
