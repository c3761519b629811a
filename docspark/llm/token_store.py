"""Token ids in a binary file format: each document compressed by itself with one shared zstandard dictionary."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices


#: The dictionary is trained on at most so many documents and so many of each one's ids; every document is stored.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2_000, 2_000, 65_536
#: Compressed bytes after which a segment is closed.
SEGMENT_BYTES = 4_000_000
_HEAD = struct.Struct("<4sHHI32s")  # magic, version, bytes of an id, documents, dictionary hash
_MAGIC, _VERSION = b"TOKS", 1
_ENTRY = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("start", "<u8"), ("n_tokens", "<u4"), ("offset", "<u8"), ("size", "<u4")])


def id_bytes(tokenizer: str, end_id: int) -> int:
    """Bytes that hold any id of the vocabulary and ``end_id``: 2 or 4."""
    from .tokens import encoder

    most = max(end_id, *encoder(tokenizer).library.get_vocab(with_added_tokens=True).values())
    if not 0 <= end_id or most >= 2**32:
        raise ValueError("ids have to be from 0 to 2**32 - 1")
    return 2 if most < 2**16 else 4


def _serialized(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary of serialized id arrays; b"" where the sample is too small to train one.

    The sample: the SAMPLE_DOCS rows whose doc_id hashes lowest.
    """
    import zstandard

    picked = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).select("doc_id").distinct()
    some = docs.join(F.broadcast(picked), "doc_id", "left_semi").select(F.coalesce(F.substring("text", 1, 8 * SAMPLE_IDS), F.lit("")).alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in slices(batches):
            got = encoder(tokenizer).encode(batch["text"].to_pylist())
            yield pa.record_batch({"b": pa.array([_serialized(np.append(x[:SAMPLE_IDS], end_id), width) for x in got], pa.binary())})

    samples = [r["b"] for r in some.mapInArrow(ids, "b binary").limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 20)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_segment(rows: list[tuple[int | None, int, int, bytes]], digest: bytes, width: int) -> bytes:
    """A segment of rows (doc_id, start, n_tokens, frame): head, index, frames."""
    index = np.zeros(len(rows), _ENTRY)
    at = 0
    for i, (doc, start, n, frame) in enumerate(rows):
        index[i] = (doc or 0, doc is None, start, n, at, len(frame))
        at += len(frame)
    return b"".join([_HEAD.pack(_MAGIC, _VERSION, width, len(rows), digest), index.tobytes(), *(r[3] for r in rows)])


def read_index(segment: bytes) -> tuple[np.ndarray, int, bytes, int]:
    """(index, bytes of an id, dictionary hash, where the frames begin) of a segment."""
    magic, version, width, n, digest = _HEAD.unpack_from(segment)
    if magic != _MAGIC or version != _VERSION:
        raise ValueError("not a token segment of this version")
    return np.frombuffer(segment, _ENTRY, n, _HEAD.size), width, digest, _HEAD.size + n * _ENTRY.itemsize


def _zstd(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int) -> None:
    """Encode every text (null: empty), add ``end_id`` and write segments under ``path`` in ascending doc_id order.

    ``path``/dictionary has one row (hash, dictionary, tokenizer settings), ``path``/segments rows (part, segment, first_id,
    last_id, n_tokens, data), ``path``/parts the ids of all parts before each part. Rows are dealt out by ranges of
    doc_id, so a part is sorted and memory is bounded by a batch and a segment. Null doc_ids come first; repeated
    doc_ids are stored one after the other. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    width = id_bytes(tokenizer, end_id)
    dictionary = train_dictionary(docs, tokenizer, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), dictionary, json.dumps({"end_id": end_id}))], "hash string, dictionary binary, settings string").coalesce(1).write.parquet(f"{path}/dictionary")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from .tokens import encoder

        press = zstandard.ZstdCompressor(level=3, dict_data=_zstd(dictionary), write_content_size=True)
        rows, held, before, part, no = [], 0, 0, None, 0

        def closed() -> pa.RecordBatch:
            ids = [r[0] for r in rows]
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "segment": pa.array([no], pa.int32()),
                    "first_id": pa.array([ids[0]], pa.int64()),
                    "last_id": pa.array([ids[-1]], pa.int64()),
                    "n_tokens": pa.array([sum(r[2] for r in rows)], pa.int64()),
                    "data": pa.array([pack_segment(rows, digest, width)], pa.binary()),
                }
            )

        for batch in slices(batches):
            docs_in = batch["doc_id"].to_pylist()
            if docs_in and part is None:
                part = batch["part"][0].as_py()
            for doc, ids in zip(docs_in, encoder(tokenizer).encode(batch["text"].to_pylist()), strict=True):
                frame = press.compress(_serialized(np.append(ids, np.uint32(end_id)), width))
                rows.append((doc, before, len(ids) + 1, frame))
                before += len(ids) + 1
                held += len(frame)
                if held >= SEGMENT_BYTES:
                    yield closed()
                    rows, held, no = [], 0, no + 1
        if rows:
            yield closed()

    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    dealt.withColumn("part", F.spark_partition_id()).mapInArrow(encoded, "part int, segment int, first_id long, last_id long, n_tokens long, data binary").write.parquet(f"{path}/segments")
    sums = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a part
    parts, before = [], 0
    for r in sums:
        parts.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(parts, "part int, tokens_before long").coalesce(1).write.parquet(f"{path}/parts")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    kept = spark.read.parquet(f"{path}/dictionary").first()
    segments = spark.read.parquet(f"{path}/segments")
    parts = spark.read.parquet(f"{path}/parts")
    n = parts.count()
    return segments.join(F.broadcast(parts) if n <= 1_000_000 else parts, "part"), bytes(kept["dictionary"])


def _documents(segment: bytes, dictionary: bytes, only: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    import zstandard

    index, width, digest, base = read_index(segment)
    if digest != hashlib.sha256(dictionary).digest():
        raise ValueError("the segment was written with another dictionary")
    press = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
    for e in index if only is None else index[(index["doc_id"] == only) & (index["no_id"] == 0)]:
        at = base + int(e["offset"])
        ids = np.frombuffer(press.decompress(segment[at : at + int(e["size"])]), f"<u{width}").astype("<u4")
        yield None if e["no_id"] else int(e["doc_id"]), int(e["start"]), ids


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, ids) of a store; start counts the ids of all documents before."""
    return _read(spark, path, lambda ids: ids.tolist(), "array<long>", "ids", None)


def read_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The document's row of ``read_store``: only segments that may hold it are read, and one frame is decompressed."""
    return _read(spark, path, lambda ids: ids.tolist(), "array<long>", "ids", doc_id)


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read back from the segments."""
    out = _read(spark, path, lambda ids: {"n": len(ids), "crc": zlib.crc32(ids.tobytes())}, "struct<n:long,crc:long>", "d", None)
    return out.select("doc_id", "start", F.col("d.n").alias("n_tokens"), F.col("d.crc").alias("ids_crc32"))


def _read(spark: SparkSession, path: str, of, kind: str, name: str, only: int | None) -> DataFrame:
    segments, dictionary = _opened(spark, path)
    if only is not None:
        segments = segments.where(F.lit(only).between(F.col("first_id"), F.col("last_id")))
    arrow = {"array<long>": pa.list_(pa.int64()), "struct<n:long,crc:long>": pa.struct([("n", pa.int64()), ("crc", pa.int64())])}[kind]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for before, data in zip(batch["tokens_before"].to_pylist(), batch["data"], strict=True):
                rows = [(d, before + s, of(ids)) for d, s, ids in _documents(data.as_py(), dictionary, only)]
                if rows:
                    ids, starts, values = zip(*rows, strict=True)
                    yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(starts, pa.int64()), name: pa.array(values, arrow)})

    return segments.select("tokens_before", "data").mapInArrow(decoded, f"doc_id long, start long, {name} {kind}")
