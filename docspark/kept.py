"""Intermediate tables in the folder that the cluster's executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only after its rows were counted and found to have at most so many bytes.
BROADCAST_BYTES = 16_000_000
#: Bytes of an Arrow batch that Spark sends to a Python task, for rows that are wide.
ARROW_BYTES = 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (as in tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: computed once, and safe from lost executors.

    ``group``: rows of a row group, for wide rows. A task holds a whole one as it writes, and as it reads.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast when its rows, counted, of about ``row_bytes`` fit into BROADCAST_BYTES; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it comes in fewer parts than there are cores (as one small file does), for work that is heavy for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of ARROW_BYTES at most from here on: bounds the buffers of executors and workers."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name).rstrip("bB")
    if not given.isdigit() or int(given) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df
