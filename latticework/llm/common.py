"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import freed, scratch, shared_dir, stored

__all__ = ["freed", "fresh", "get_bucketed", "put_bucketed", "scratch", "shared_dir", "slices", "small_batches", "stored", "table", "text_udf", "tidied", "tidy"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write a table with a file (or a few) for each bucket of a key. The catalog knows it for the time of writing only."""
    name = f"latticework_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"drop table {name}")


def get_bucketed(spark: SparkSession, path: str, columns: str, key: str, buckets: int) -> DataFrame:
    """A table written by ``put_bucketed``: joins on its key don't shuffle it."""
    name = f"latticework_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({columns}) using parquet clustered by ({key}) sorted by ({key}) into {buckets} buckets location '{path}'")
    found = spark.table(name)
    found.schema  # resolved, so that the name isn't needed any more
    spark.sql(f"drop table {name}")
    return found


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name in taken:
        name += "_"
    return name


#: Texts of a batch that are Python objects at one time.
SLICE_ROWS = 500
#: Rows of an Arrow batch between the JVM and Python. Spark's own 10,000 rows are made for narrow ones; of whole texts they fill memory on both sides.
BATCH_ROWS, BATCH_KEY, BATCH_DEFAULT = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Make a session's Arrow batches small, unless its owner has chosen a size. Queries and pipeline stages ask for it; whoever calls an operator directly on long texts should set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to about 1000, since operators leave the session's settings alone."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def tidy() -> None:
    """Give memory back that a worker no longer uses: workers live on, and what they hold would add up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def tidied(batches_to_batches: Callable) -> Callable:
    """The same function over batches, with ``tidy`` after each of its results and at its end."""

    @wraps(batches_to_batches)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in batches_to_batches(batches):
            yield out
            tidy()
        tidy()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_udf(make, kind: str):
    """Arrow UDF over whole texts. ``make()`` gives, once per batch, a function from a str to a tuple in the order of ``kind``.

    A null text reaches the function as "".
    """

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        one = make()
        target = run_type
        rows = [one("" if t is None else t) for at in range(0, len(texts), SLICE_ROWS) for t in texts.slice(at, SLICE_ROWS).to_pylist()]
        tidy()
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], fields=list(target))

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    run_type = to_arrow_type(_parse_datatype_string(kind))
    # or else a filter on the result is pushed below it, and every text goes through a second worker for the filter alone
    return run.asNondeterministic()
