"""A store of several tables in buckets, in versions that readers see whole.

Every table lies in folders of one write each, cut into buckets by the hash of its key. A commit record names, for each table and bucket, the folders that hold it; it is one file, put in place by a
rename that fails if the next version is there already. So a writer that stops half-way leaves files that no record names, and of two writers that began with one version the second gets a ``Conflict`` and starts
again from the new one. A batch reads the buckets of the keys that it asks for, and writes those; indexes only gain rows, whose buckets are merged after ``PARTS`` writes.

A record has an entry for each table and bucket, so the number of buckets is chosen once, such that one holds some 100,000 rows; a record of 10,000 buckets and ten tables has some 10 MB.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, mirror
from ..storage import remove

BUCKETS, PARTS = 64, 16


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def stem(slug: Column) -> Column:
    """A slug without numbers at its end, so that all slugs that a name can get lie together."""
    return F.regexp_replace(slug, r"(-\d+)+$", "")


#: By what a table is dealt to buckets: from its row, and from a key that is asked for.
ROW_KEYS = {
    "papers": F.col,
    "nodes": lambda _: stem(F.col("slug")),
    "candidates": lambda _: F.least("slug_a", "slug_b"),
}
COLUMNS = {"papers": "slug", "nodes": "slug", "mentions": "node_slug", "relations": "from_slug", "candidates": "slug_a", "names": "key", "by_paper": "paper_slug", "waiting": "concept_slug", "hashes": "text_hash"} | mirror.COLUMNS
INDEXES = ingest.INDEXES | mirror.INDEXES
KINDS = ingest.TABLES | mirror.TABLES | INDEXES


def path_of(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    p, fs = path_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not be there yet, all of it or nothing."""
    sc = spark.sparkContext
    target, fs = path_of(spark, path)
    draft, _ = path_of(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration())
    plainly = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, target, plainly)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(target):
            raise Conflict(path) from e
        raise


def get(spark: SparkSession, path: str) -> str:
    p, fs = path_of(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Versions:
    """One version of a store, and what a batch has read of it. Made by ``opened``."""

    def __init__(self, spark: SparkSession, root: str, number: int, record: dict):
        self.spark, self.root, self.number, self.record = spark, root, number, record
        self.touched: dict[str, set[int]] = {}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.record["buckets"])).cast("int")

    def row_bucket(self, name: str) -> Column:
        return self.bucket(ROW_KEYS.get(name, F.col)(COLUMNS[name]))

    def parts(self, name: str, buckets) -> list[str]:
        there = self.record["tables"].get(name, {})
        return [f"{self.root}/data/{folder}/bucket={b}" for b in sorted(buckets) for folder in there.get(str(b), [])]

    def read(self, name: str, buckets) -> DataFrame:
        paths = self.parts(name, buckets)
        return self.spark.read.schema(KINDS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], KINDS[name])

    def table(self, name: str) -> DataFrame:
        """All of a table or index."""
        return self.read(name, [int(b) for b in self.record["tables"].get(name, {})])

    def asked(self, name: str, keys: tuple[DataFrame, ...]) -> set[int]:
        """Buckets of keys; as many numbers at most as there are buckets."""
        if not keys or not self.record["tables"].get(name) and name in INDEXES:
            return set()
        every = None
        for k in keys:
            key = F.col(k.columns[0])
            one = k.select(self.bucket(stem(key) if name == "nodes" else key).alias("b"))
            every = one if every is None else every.unionAll(one)
        return {r[0] for r in every.distinct().collect()}

    def rows(self, name: str, *keys: DataFrame) -> DataFrame:
        """The buckets of a table in which the keys' rows lie. ``commit`` takes them as they are afterwards."""
        mine = self.asked(name, keys)
        self.touched[name] = self.touched.get(name, set()) | mine
        return self.read(name, mine)

    def index(self, name: str, *keys: DataFrame) -> DataFrame:
        return self.read(name, self.asked(name, keys))

    def write(self, name: str, rows: DataFrame) -> tuple[str, set[int]]:
        """A folder of rows in buckets, and the buckets that it has. Large buckets are written by several tasks."""
        folder = f"{name}-{uuid.uuid4().hex}"
        path = f"{self.root}/data/{folder}"
        rows.withColumn("bucket", self.row_bucket(name)).hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
        return folder, {int(f.split("=")[1]) for f in listed(self.spark, path) if f.startswith("bucket=")}

    def commit(self, after: dict[str, DataFrame], gains: dict[str, DataFrame], writer: str | None = None, batch: int | None = None) -> Versions:
        """The next version: the rows that were read as they are in ``after``, and the indexes with ``gains``. ``writer`` and ``batch`` are kept, so that a batch that runs again is known."""
        tables = {t: dict(b) for t, b in self.record["tables"].items()}
        for name, rows in after.items():
            folder, made = self.write(name, rows)
            was = self.touched.get(name, set())
            if not made <= was:
                raise ValueError(f"rows of {name} outside the buckets that were read: {sorted(made - was)[:5]}")
            tables[name] = {b: f for b, f in tables.get(name, {}).items() if int(b) not in was} | {str(b): [folder] for b in made}
        for name, rows in gains.items():
            folder, made = self.write(name, rows.distinct())
            there = tables.get(name, {})
            tables[name] = there | {str(b): [*there.get(str(b), []), folder] for b in made}
            full = [b for b in made if len(tables[name][str(b)]) > PARTS]
            if full:
                paths = [f"{self.root}/data/{f}/bucket={b}" for b in full for f in tables[name][str(b)]]
                folder, merged = self.write(name, self.spark.read.schema(KINDS[name]).parquet(*paths).distinct())
                tables[name] |= {str(b): [folder] for b in merged}
        writers = self.record["writers"] | ({writer: batch} if writer is not None else {})
        record = {"buckets": self.record["buckets"], "writers": writers, "tables": tables}
        put_new(self.spark, f"{self.root}/commits/{self.number + 1:012}.json", json.dumps(record))
        return Versions(self.spark, self.root, self.number + 1, record)


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 if there is none."""
    return max((int(n.split(".")[0]) for n in listed(spark, f"{root}/commits") if n.endswith(".json") and not n.startswith(".")), default=0)


def opened(spark: SparkSession, root: str, number: int | None = None, buckets: int = BUCKETS) -> Versions:
    """A version, the newest by default; version 0 is an empty store, whose buckets are chosen here."""
    number = latest(spark, root) if number is None else number
    record = json.loads(get(spark, f"{root}/commits/{number:012}.json")) if number else {"buckets": buckets, "writers": {}, "tables": {}}
    return Versions(spark, root, number, record)


def created(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int = BUCKETS, indexes: dict[str, DataFrame] | None = None) -> Versions:
    """The first version, of whole tables; their indexes are those of an ingest store unless given."""
    v = opened(spark, root, 0, buckets)
    v.touched = {t: set(range(buckets)) for t in tables}
    return v.commit(tables, ingest.indexes_of(tables) if indexes is None else indexes)


def expire(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Delete the records but for the last ``keep``, and the folders that these don't name; to be called while nobody writes. How many folders went."""
    numbers = sorted(int(n.split(".")[0]) for n in listed(spark, f"{root}/commits") if n.endswith(".json") and not n.startswith("."))
    used = set()
    for n in numbers[-keep:]:
        used |= {f for t in opened(spark, root, n).record["tables"].values() for fs in t.values() for f in fs}
    for n in numbers[:-keep]:
        remove(spark, f"{root}/commits/{n:012}.json")
    gone = [f for f in listed(spark, f"{root}/data") if f not in used]
    for f in gone:
        remove(spark, f"{root}/data/{f}")
    return len(gone)
