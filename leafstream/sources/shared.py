"""Intermediate tables that outlive the loss of an executor.

They are written to the folder the cluster names in ``spark.checkpoint.dir``; only a session on one machine that names
none (a test) gets a folder of its own.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset on a cluster: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="leafstream-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = "file://" + folder
    return _OWN[app]


class Scope:
    """The tables that are settled within ``with scope:``, to be deleted together when no one reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        _SCOPES.stack = [*getattr(_SCOPES, "stack", []), self]
        return self

    def __exit__(self, *error) -> None:
        _SCOPES.stack = _SCOPES.stack[:-1]

    def close(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, self.paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, known to the scope around."""
    path = f"{shared_folder(spark)}/leafstream/{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    for scope in getattr(_SCOPES, "stack", [])[-1:]:
        scope.paths.append(path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage ends there. A :class:`Scope` around says when the
    table goes; without one it stays, for whoever reads the result."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
