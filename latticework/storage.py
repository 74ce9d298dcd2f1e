"""Where plans are cut: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only in local mode, where driver and executors are one process, an unset one is replaced by a folder of our own;
    on a cluster that is an error, for a machine's own folder would not be shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="latticework-")
    return _OWN[app]


def remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is scratch space
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/latticework/{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stored(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that no later plan reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            remove(df.sparkSession, f.rsplit("/", 1)[0])
