"""Best-fit packing of documents into sequences, certified by lower bounds on the number of sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, keep, slices

CAPACITY = 2048
#: Pieces that one task packs at once, and partitions that exchange pieces in a repacking round.
GROUP_PIECES, FAN_IN = 40_000, 8
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, round int, grp int, bin int, offset long, open boolean"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one unless it is too long; then the first takes what is left over."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, length, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of ``docs`` (doc_id, text); null text: only the end id."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        for batch in slices(batches):
            out = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder(tokenizer).encode(batch["text"].to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            if out:
                names, kinds = ("doc_id", "piece", "start", "length", "ids_crc32"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch({k: pa.array(x, t) for k, x, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return bounded(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, each into the fullest bin with room for it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[int] = []  # the distinct free sizes, ascending
    at: dict[int, list[int]] = {}  # the bins of each
    n = 0
    for i in order.tolist():
        size = int(lengths[i])
        k = bisect_left(rooms, size)
        if k == len(rooms):
            free, b = capacity, n
            n += 1
        else:
            free = rooms[k]
            b = at[free].pop()
            if not at[free]:
                del at[free], rooms[k]
        bins[i], offsets[i] = b, capacity - free
        free -= size
        if free:
            if free not in at:
                at[free] = []
                insort(rooms, free)
            at[free].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The best bound of two families of dual feasible functions: no packing has fewer bins. ``counts``: of each length, else 1.

    For a threshold k: items over capacity - k count whole, those under k count nothing, others their share. And
    for p: an item counts floor((p + 1) x / capacity) of p, one that meets such a step exactly its share.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True) if counts is None else (lengths, counts)
    best = -(-int(sizes @ counts) // capacity)
    for k in np.unique(sizes[sizes <= capacity // 2]):
        f = np.where(sizes > capacity - k, capacity, np.where(sizes < k, 0, sizes))
        best = max(best, -(-int(f @ counts) // capacity))
    for p in range(1, 40):
        on_step = (p + 1) * sizes % capacity == 0
        f = np.where(on_step, sizes * p, (p + 1) * sizes // capacity * capacity)
        best = max(best, -(-int(f @ counts) // (capacity * p)))
    return best


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound) of a whole packing: equal numbers prove that no packing has fewer sequences."""
    made = packed.select("sequence_id").distinct().count()
    got = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most a row for each length up to the capacity
    return made, lower_bound(got["length"].to_numpy(np.int64), capacity, got["n"].to_numpy(np.int64))


def _packed(capacity: int, level: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, lengths, n)
        gap = n - lower_bound(lengths, capacity)
        # where the bound shows that the count can't be lower, only the emptiest bin may still gain from others
        spare = fill < capacity if gap > 0 else fill == fill.min()
        return frame.assign(round=level, bin=bins.astype("int32"), offset=offsets, open=(spare & (fill < capacity))[bins])

    return pack


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Round 0 deals the pieces out evenly by hash to partitions of about GROUP_PIECES and packs each. A partition's bound
    certifies its count or shows a gap. All bins with room of partitions with a gap, and the emptiest bin of the
    others, are opened; FAN_IN partitions exchange what was in them and pack it again, until one partition is left or
    a round saves no bin. A group never holds more than GROUP_PIECES or so: opened bins are dealt out anew when they are
    too many for one task. Bins are never split over tasks, pieces never lost. Works alike for equal lengths (ties by row),
    repeated rows and null doc_ids (each row is packed) and an empty table (no rows). See ``certificate`` for the proof of the whole.
    """
    rows = keep(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") == capacity)
    rest = rows.where(F.col("length") < capacity)
    n = rest.count()
    groups = max(1, -(-n // GROUP_PIECES))
    todo = rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    done, opened, level = [], None, 0
    while True:
        shape = todo.select("doc_id", "piece", "start", "length", "ids_crc32", "row", "grp", F.lit(0).alias("round"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("open"))
        got = keep(shape.groupBy("grp").applyInPandas(_packed(capacity, level), shape.schema), "packed")
        bins = got.groupBy("open").agg(F.count_distinct("grp", "bin").alias("bins"), F.count(F.lit(1)).alias("n")).collect()  # two rows
        if groups == 1 or (opened is not None and sum(r["bins"] for r in bins) >= opened):
            done.append(got)
            break
        done.append(got.where("not open"))
        opened, left = next(((r["bins"], r["n"]) for r in bins if r["open"]), (0, 0))
        if not left:
            break
        groups = 1 if left <= GROUP_PIECES else -(-groups // FAN_IN) if left <= GROUP_PIECES * -(-groups // FAN_IN) else -(-left // GROUP_PIECES)
        level += 1
        todo = got.where("open").withColumn("grp", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)).cast("int"))
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionByName(more)
    ids = (F.col("round").cast("long") * (1 << 58)) + F.col("grp").cast("long") * (1 << 26) + F.col("bin")
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", ids.alias("sequence_id"), "offset").unionByName(alone)
