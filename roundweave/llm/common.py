"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to Python at a time. Texts may be long, so batches are small.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound each Arrow batch, and so the memory of a Python worker.

    Queries run later than they are made, so the session keeps these two settings.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (local tests) is one made.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):  # a local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders that ``saved`` has written within each open ``scratch``.
_scratch: list[list[str]] = []


def saved(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so that what several branches read is computed once and a
    lost executor costs no recomputation of it. ``keep`` leaves it when a ``scratch`` ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``saved`` DataFrame that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators within have ``saved`` for themselves."""
    _scratch.append([])
    try:
        yield
    finally:
        for folder in _scratch.pop():
            _delete(spark, folder)


def utf8(column: str) -> F.Column:
    """A text column as bytes, null as empty, for Python code that decodes leniently."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes with their bits spread, so that order and low bits can be used."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: What empties the caches that operators keep in a Python worker, by operator.
CACHES: dict[str, Callable[[], None]] = {}


def only_caches_of(owner: str) -> None:
    """Called in a task: empty what other operators keep in this Python worker, as workers are used again."""
    for name, empty in CACHES.items():
        if name != owner:
            empty()
