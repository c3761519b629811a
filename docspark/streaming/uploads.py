"""An upload stream that judges every file and every manifest row, and its two tables written as one."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import digest, has_magic
from ..operators.integrity import orphans
from ..operators.validate import MAX_BYTES, upload_outcome
from ..plans import ingest_uploads

_FILES = "path string, modificationTime timestamp, length long, content binary"
UNLISTED = "404 unlisted"


def stream_files(spark: SparkSession, files: str, most: int = MAX_BYTES, magic: bytes = b"%PDF-") -> DataFrame:
    """Rows (path, found_at, size, magic, checksum) of files as they arrive. Larger ones than ``most`` are listed, not opened.

    Names only: the last part of each path. The reader leaves empty files out; a manifest tells of those.
    """
    found = spark.readStream.format("binaryFile").schema(_FILES).load(files)
    own = [F.element_at(F.split("path", "/"), -1).alias("path"), F.col("modificationTime").alias("found_at"), F.col("length").alias("size")]
    opened = found.where(F.col("length") <= most).select(*own, has_magic(F.col("content"), magic).alias("magic"), digest(F.col("content")).alias("checksum"))
    listed = found.where(F.col("length") > most).select(*own, F.lit(None).cast("boolean").alias("magic"), F.lit(None).cast("string").alias("checksum"))
    return opened.unionByName(listed)


def judge_uploads(files: DataFrame, manifest: DataFrame, at: str = "sent_at", apart: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Every file and every manifest row of two streams, once, with size, checksum and outcome.

    ``manifest``: path, drug_name, content_type, has_file and the time ``at``; ``files`` as ``stream_files`` gives them. A file and a row of
    its path belong together if they come within ``apart`` of each other, in either order. A row whose file doesn't come has no
    bytes ("400 empty" if nothing else is wrong before); a file whose row doesn't come is "404 unlisted". These two come out when
    the watermarks of both streams (``late``) have passed their time; until then Spark's state holds them, without content.
    """
    here = files.select(F.col("path").alias("file_path"), F.col("found_at").cast("timestamp").alias("found_at"), "size", "magic", "checksum").withWatermark("found_at", late)
    told = manifest.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    near = F.expr(f"path = file_path AND found_at BETWEEN {at} - INTERVAL {apart} AND {at} + INTERVAL {apart}")
    both = told.join(here, near, "full_outer")
    outcome = upload_outcome(F.col("drug_name"), F.col("has_file"), F.col("content_type"), F.col("size"), F.col("magic"))
    judged = both.withColumn("outcome", F.when(F.col(at).isNull(), UNLISTED).otherwise(outcome))
    return judged.withColumn("path", F.coalesce("path", "file_path")).drop("file_path", "magic")


def _overwrite(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def compensated(first: Callable[[], None], then: Callable[[], None], undo: Callable[[], None]) -> None:
    """Do ``first`` and ``then``. If ``then`` fails, ``undo`` the first, say nothing of its own failure, and raise the first error."""
    first()
    try:
        then()
    except Exception:
        with contextlib.suppress(Exception):
            undo()
        raise


def store_uploads(judged: DataFrame, objects: str, catalog: str, refused: str, checkpoint: str, payload: Column, now: Column) -> StreamingQuery:
    """Start a query that writes what has arrived of ``judged`` to three Parquet tables, and then ends.

    Each micro-batch is a partition (batch=n) of every table, overwritten when it is replayed: wherever a run stops, even between two
    of the writes, the next run with this ``checkpoint`` writes the batch again and each row stands there once. If the catalog can't be
    written, the batch's objects are taken back. Ids are digests of path and content, so that a replay gives the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("id", F.sha2(F.concat_ws("|", "path", "checksum", F.col("found_at").cast("double").cast("string")), 256)).persist()
        try:
            stored, rows, bad = ingest_uploads(named, payload, now)
            compensated(lambda: _overwrite(stored, objects, number), lambda: _overwrite(rows, catalog, number), lambda: _overwrite(stored.limit(0), objects, number))
            _overwrite(bad, refused, number)
        finally:
            named.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile(spark: SparkSession, objects: str, catalog: str) -> DataFrame:
    """The stored objects that no catalog row names, of batches that both tables have (others may still be under way)."""
    stored, rows = spark.read.parquet(objects), spark.read.parquet(catalog)
    done = rows.select("batch").distinct()
    return orphans(stored.join(done, "batch", "left_semi"), rows.select(F.col("file_address").alias("object_address")), "object_address")


def remove_orphans(spark: SparkSession, objects: str, catalog: str, scratch: str) -> int:
    """Delete what ``reconcile`` finds; returns how many. Only the partitions that have any are written anew, by way of ``scratch``."""
    gone = reconcile(spark, objects, catalog).select("object_address", "batch")
    n = gone.count()
    if n:
        stored = spark.read.parquet(objects)
        kept = stored.join(gone.select("batch").distinct(), "batch", "left_semi").join(gone, ["object_address", "batch"], "left_anti").select(*stored.columns)
        kept.write.mode("overwrite").partitionBy("batch").parquet(scratch)
        touched = [r["batch"] for r in gone.select("batch").distinct().collect()]  # batches with orphans
        left = spark.read.schema(kept.schema).parquet(scratch)
        for batch in touched:
            _overwrite(left.where(F.col("batch") == batch).drop("batch"), objects, batch)
    return n
