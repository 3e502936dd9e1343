"""The folder that all executors of a cluster can reach."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Folders made for local sessions without the setting, by application; gone at exit.
_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """``name`` below the folder set in ``spark.checkpoint.dir``.

    The caller owns what it puts there and clears it.  Only a session within one process
    may go without the setting; it has one temporary folder, removed at exit.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="run-")
            atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
        root = _LOCAL[context.applicationId]
    return f"{root.rstrip('/')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read again; a job that runs at once."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
