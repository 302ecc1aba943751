"""Intermediate tables in the folder all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set and the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-shared")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"


#: Bytes of a row group, which a writer holds in memory for each task.
ROW_GROUP = 16 << 20
#: Bytes of an Arrow batch, held on both sides of a Python worker.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for this session from now on (a lower bound that is set already stays)."""
    now = spark.conf.get(_BATCH, None)
    if not (now and now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def stash(df: DataFrame, label: str, narrow: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    ``narrow`` is for tables of a few numbers a row: no more files than cores; ``codec`` is the files' compression, the
    session's if not given.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = track(spark, new_path(spark, label))
    schema = df.schema
    if narrow:
        df = df.coalesce(spark.sparkContext.defaultParallelism)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=codec)
    out = spark.read.schema(schema).parquet(path)
    out._stashed_at = path
    return out


_made: dict[str, list[str]] = {}  # tables of each application, oldest first


def track(spark: SparkSession, path: str) -> str:
    """Count a folder among the application's tables, so that it is deleted with them."""
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    made = _made.get(spark.sparkContext.applicationId, [])
    if path in made:
        made.remove(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_all(spark: SparkSession) -> None:
    """Delete all of the application's tables that are still there: once no result is read any more."""
    for path in list(_made.get(spark.sparkContext.applicationId, [])):
        _delete(spark, path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables made inside, but for those passed to what it yields. One driver thread at a time."""
    before, kept = set(_made.get(spark.sparkContext.applicationId, [])), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stashed_at)
        return df

    yield keep
    for path in [p for p in _made.get(spark.sparkContext.applicationId, []) if p not in before | kept]:
        _delete(spark, path)


def tidy(spark: SparkSession) -> None:
    """Let the driver notice shuffles that nothing reads any more, so that their files go now."""
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``stash`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_stashed_at", None)
        if path:
            _delete(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
