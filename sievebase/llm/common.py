"""Shared pieces: reading tables, checkpoints, hash folds, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.checkpoints import new_path as checkpoint_folder
from ..plans.checkpoints import shared_folder

#: Words of several contracts: runs of anything but ASCII white space.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For ``bytes.translate``: lower-cases A-Z and turns the six blanks into spaces.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, its lineage cut.

    The shuffle files of that run go as soon as it is written.
    """
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.where(F.lit(True)).checkpoint(eager=True)  # a new frame: the setting holds for frames made after it
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes the files of a frame that :func:`checkpointed` returned and that nothing reads any more."""
    held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if held.isDefined():
        delete(df.sparkSession, held.get())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder in whatever store ``path`` names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of about BATCH_BYTES.

    Spark's own bound counts rows only, so one batch of long texts could fill a worker's memory.  The
    session's setting is raised from nothing once and left as it is where the user has set it.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) is None:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, what: str = "text") -> DataFrame:
    """(``what``, label) of every labelled document outside the held-out fold.

    Null ids and null labels teach nothing; several labels of one document each count once.
    """
    named = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label"))
    named = named.where(fold(F.col("doc_id"), modulus) != held).distinct()
    rows = docs.where(fold(F.col("doc_id"), modulus) != held).select("doc_id", what)
    return rows.join(named, "doc_id").select(what, "__label")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name in taken:
        name += "_"
    return name


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


__all__ = [
    "BLANKS", "LOWER", "LOWER_BYTES", "UPPER", "checkpoint_folder", "checkpointed", "delete", "drop_checkpoint", "fold", "fresh", "learning_rows", "mapped", "sigmoid", "table", "texts",
]
