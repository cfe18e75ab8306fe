"""Shared working storage of the session."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from gridtide.sources import storage

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _base(spark: SparkSession) -> str:
    """The session's folder below ``spark.checkpoint.dir``, which a cluster sets to shared storage.

    Where it is unset, as in a test, a local session gets a folder of its own until Python ends. A
    cluster session does not: its executors could not see it.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"Set {CHECKPOINT_DIR} to a shared folder")
        base = _own_folder()
    return f"{base.rstrip('/')}/gridtide-{spark.sparkContext.applicationId}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    import atexit

    folder = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_folder(spark: SparkSession) -> str:
    """A new folder name in the session's work folder."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete all that this session has stored. Frames over it can no longer be read."""
    storage.delete(spark, _base(spark))


def written(frame: DataFrame) -> DataFrame:
    """Store a frame as a table in the work folder and read it back: lineage ends there, and lost
    executors cost nothing that was already computed."""
    spark = frame.sparkSession
    path = f"{work_folder(spark)}/table"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
