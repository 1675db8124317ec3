"""The folder that driver and executors share, and cutting lineage in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where the session has none, as in local tests, is one made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):  # a local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder in the shared one that isn't there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
