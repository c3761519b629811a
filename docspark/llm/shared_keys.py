"""Which keys of a document also occur in another one: the shuffle that both passage operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import bounded, slices

#: Bytes of text for each of the parts that keys are dealt to.
PART_BYTES = 5_000_000
#: Parts at least. A document's keys come back in a row from each part that has any of them.
LEAST_PARTS = 128
_KINDS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def parts_for(docs: DataFrame, part_bytes: int = PART_BYTES, least: int = LEAST_PARTS) -> int:
    """Parts of about ``part_bytes`` of text; never fewer than ``least`` or than the shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), least, -(-total // part_bytes))


def key_bytes(parts: int) -> int:
    """Bytes of a key that are sent: enough for keys that agree by chance to be rare among the keys of ``parts``."""
    return min(8, -(-((parts * PART_BYTES).bit_length() + 6) // 8))


def cut_keys(keys: np.ndarray, width: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * width)) - 1)


def pack_keys(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(data: list[bytes], width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel().astype(np.uint64)


def _by_doc(keys: np.ndarray, docs: np.ndarray, width: int) -> pa.RecordBatch | None:
    if not len(keys):
        return None
    order = np.argsort(docs, kind="stable")
    keys, docs = keys[order], docs[order]
    cuts = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1, append=docs[-1] + 1))
    blobs = [pack_keys(keys[a:b], width) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    n = len(blobs)
    return pa.record_batch([pa.nulls(n, pa.int32()), pa.array(docs[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary())], schema=_KINDS)


def shared_keys(docs: DataFrame, keys_of: Callable[..., list[np.ndarray]], parts: int, columns: tuple[str, ...] = ("text",), packed: str | None = None) -> DataFrame:
    """Rows (doc_id, keys): for each document, its keys (packed to ``key_bytes``) that other documents have as well.

    ``docs`` has unique doc_ids and no null texts; ``keys_of`` gives the keys of each text, from lists of the ``columns`` (of
    which one may be ``packed``, see ``zipped``). Within a batch a key of
    several documents is known to be shared at once and only one of them is sent on, so a very common key costs a
    task one row per batch, not one per document. Keys are dealt out by their value in packed arrays.
    """

    width = key_bytes(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, packed):
            own = [np.unique(cut_keys(k, width)) for k in keys_of(*(batch[c].to_pylist() for c in columns))]
            if not own:
                continue
            keys = np.concatenate(own)
            ids = np.repeat(batch["doc_id"].to_numpy(zero_copy_only=False), [*map(len, own)])
            order = np.lexsort((ids, keys))
            keys, ids = keys[order], ids[order]
            if not len(keys):
                continue
            first = np.diff(keys, prepend=keys[0] ^ np.uint64(1)) != 0
            group = np.cumsum(first) - 1
            many = np.bincount(group)[group] > 1
            if (got := _by_doc(keys[many], ids[many], width)) is not None:
                yield got
            # the smallest document of each key goes on, and a byte that says whether others are known already
            keys, ids, flag = keys[first], ids[first], many[first]
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, ids, flag, part = keys[order], ids[order], flag[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            rows = [(int(part[a]), pack_keys(keys[a:b], width), ids[a:b].tobytes() + flag[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            p, k, d = zip(*rows, strict=True)
            yield pa.record_batch([pa.array(p, pa.int32()), pa.nulls(len(p), pa.int64()), pa.array(k, pa.binary()), pa.array(d, pa.binary())], schema=_KINDS)

    sent = bounded(docs).select("doc_id", *columns).mapInArrow(send, "part int, doc_id long, keys binary, docs binary")

    def meet(group: pa.Table) -> pa.Table:
        told = group.filter(pc.is_valid(group["doc_id"]))
        group = group.filter(pc.is_null(group["doc_id"]))
        if not group.num_rows:
            return told.select(["doc_id", "keys"])
        keys = unpack_keys(group["keys"].to_pylist(), width)
        blobs = group["docs"].to_pylist()
        ids = np.concatenate([np.frombuffer(x, np.int64, len(x) // 9) for x in blobs])
        known = np.concatenate([np.frombuffer(x, bool, len(x) // 9, len(x) // 9 * 8) for x in blobs])
        order = np.argsort(keys, kind="stable")
        keys, ids, known = keys[order], ids[order], known[order]
        first = np.diff(keys, prepend=keys[0] ^ np.uint64(1)) != 0
        run = np.cumsum(first) - 1
        shared = np.bincount(run)[run] > 1
        got = _by_doc(keys[shared & ~known], ids[shared & ~known], width)
        out = pa.Table.from_batches([got] if got is not None else [], _KINDS).select(["doc_id", "keys"])
        return pa.concat_tables([out, told.select(["doc_id", "keys"]).cast(out.schema)])

    # what a task already knows to be shared goes along to a part of its own number, so that the texts are read once
    part = F.coalesce("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).alias("part")
    found = sent.select(part, "doc_id", "keys", "docs").groupBy("part").applyInArrow(meet, "doc_id long, keys binary")
    return found.groupBy("doc_id").agg(F.collect_list("keys").alias("keys"))
