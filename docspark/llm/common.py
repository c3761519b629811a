"""Shared helpers: tables kept in the cluster's shared folder, and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only after its rows were counted and found to have at most so many bytes.
BROADCAST_BYTES = 16_000_000
#: Bytes of text that a Python task handles at once, and of an Arrow batch that Spark sends to it.
SLICE_BYTES, ARROW_BYTES = 3_000_000, 4_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset on one machine (as in tests), a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast when its counted ``rows`` of about ``row_bytes`` fit into BROADCAST_BYTES; otherwise Spark shuffles it."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def text_bytes(df: DataFrame, *columns: Column) -> tuple[int, int]:
    """Rows of ``df`` and the bytes a row of ``columns`` (of text) has on average, as ``small`` takes them."""
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum((F.octet_length(c) for c in columns), F.lit(0))), F.lit(0))).first()
    return n, total // max(n, 1) + 16


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, whose session sends Arrow batches of ARROW_BYTES at most from here on: bounds the buffers of executors and workers."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name).rstrip("bB")
    if not given.isdigit() or int(given) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return docs


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker waits for its next task with all it ever took otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def _row_bytes(column: pa.Array) -> np.ndarray:
    """The bytes that each row of a column takes in Python, roughly."""
    if pa.types.is_list(column.type):
        inner = np.append(0, np.cumsum(_row_bytes(column.flatten())))
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        return inner[ends] - inner[ends - lengths]
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8, np.int64)


def slices(batches: Iterator[pa.RecordBatch], packed: str | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that a slice has about ``most`` bytes in all its columns: bounds a task's memory.

    Of the column ``packed`` (see ``zipped``) the bytes before compression count, which stand in each frame's head.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.zeros(batch.num_rows, np.int64)
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            total += _raw_bytes(column) if name == packed else _row_bytes(column)
        cuts = np.flatnonzero(np.diff(np.cumsum(total) // most, append=-1)) + 1
        at = 0
        for to in cuts.tolist():
            yield batch.slice(at, to - at)
            at = to
    give_back()


def _raw_bytes(column: pa.Array) -> np.ndarray:
    import zstandard

    return np.fromiter((zstandard.get_frame_parameters(x).content_size if x else 0 for x in column.to_pylist()), np.int64, len(column))


def zipped(docs: DataFrame) -> DataFrame:
    """``docs`` with its text compressed to binary, for joins that have to shuffle whole texts; undone by ``unzipped``."""
    shape = docs.select(*(F.col(c) for c in docs.columns if c != "text"), F.encode("text", "UTF-8").alias("text")).schema

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = pa.array([tool.compress(t.encode()) for t in batch["text"].to_pylist()], pa.binary())
            yield batch.drop_columns(["text"]).append_column("text", packed)

    return bounded(docs).select(*(c for c in docs.columns if c != "text"), "text").mapInArrow(press, shape)


def unzipped(data: list[bytes]) -> list[bytes]:
    """The UTF-8 bytes of each text packed by ``zipped``."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    return [tool.decompress(x) for x in data]


def row_mark(text: Column) -> Column:
    """With the doc_id, what tells rows apart that repeat a doc_id: a hash of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without(docs: DataFrame, gone: DataFrame, by_text: bool = True) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``row_mark`` are in ``gone`` (doc_id, mark): few are broadcast, many are shuffled.

    A null doc_id equals another one. Rows with the same doc_id and text go or stay together; without ``by_text``
    all rows with the doc_id do, and ``gone`` needs no mark.
    """
    mark = F.col("mark") if by_text else F.lit(0).cast("long")
    gone = keep(gone.select(F.col("doc_id").alias("gone_id"), mark.alias("gone_mark")).distinct(), "gone")
    same = docs["doc_id"].eqNullSafe(gone["gone_id"])
    if by_text:
        same &= row_mark(docs["text"]) == gone["gone_mark"]
    return docs.join(small(gone, gone.count(), 16), same, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, label), label being the smallest node of the component.

    Each round takes the smallest label among the neighbours and then follows labels of labels, so that the
    number of rounds is logarithmic for the star-shaped edge sets which the callers make. Every round is written
    to the shared folder. A node of many edges is combined before the shuffle (``min``), and joins on labels are
    sort-merge joins that adaptive execution may split.
    """
    both = keep(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("new"))
        root = labels.select(F.col("node").alias("new"), F.col("label").alias("root"))
        moved = keep(step.join(root, "new", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("root", "new")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels
