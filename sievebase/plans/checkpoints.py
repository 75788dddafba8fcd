"""Cutting lineage, and tables in between, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where none is set a temporary folder is made if all tasks run
    in this process (as in tests); on a cluster that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, in whatever store (none if it isn't there)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []
