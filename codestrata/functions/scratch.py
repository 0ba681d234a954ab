"""Cutting lineage between the rounds of iterative operators, and the size of batches that go to Python."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch of texts on its way to Python.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already: a batch of long texts takes several times its size in buffers."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


#: A side is broadcast only up to this many bytes (rows times the given width); beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (cut before) with a broadcast hint if rows times ``row_bytes`` is at most BROADCAST_BYTES, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a temporary one only where that is unset and all executors are in this process)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="codestrata-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: like ``cut``, but compressed, for large tables that are used more than once."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
