"""Shortest-pack-first packing over the histogram of lengths, joined back to documents by rank.

Only the histogram (a count for each length up to the capacity) reaches the driver. There lengths are placed longest
first, each into the emptiest packing pattern with room for it, and patterns carry counts; so the plan's size depends on the
capacity and not on the number of documents. A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, keep, slices, small

CAPACITY = 2048
#: A pattern: sequences of this kind, their free room, and (length, copies) in the order of the places.
Pattern = tuple[int, int, list[tuple[int, int]]]


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (count, room, [(length, copies)]) that hold ``counts`` pieces of each length.

    Each length splits one pattern at most and opens one at most, so there are at most two patterns for each length.
    """
    by_room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        todo, room = counts[length], capacity
        while todo:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                by_room[capacity - length].append((todo, [(length, 1)]))
                break
            n, held = by_room[room].pop()
            if n > todo:
                by_room[room].append((n - todo, held))
                n = todo
            last, copies = held[-1]
            more = [*held[:-1], (last, copies + 1)] if last == length else [*held, (length, 1)]
            by_room[room - length].append((n, more))
            todo -= n
    return [(n, room, held) for room in range(capacity + 1) for n, held in by_room[room]]


class Plan(NamedTuple):
    """Where the pieces go. Slots are sorted by ``key``, a length's slots by rank; receivers by ``gap_at``."""

    key: np.ndarray  # length << 44 | first rank of the slot
    rank: np.ndarray  # first rank
    length: np.ndarray
    copies: np.ndarray
    seq: np.ndarray  # the pattern's first sequence
    at: np.ndarray  # offset of the slot in its sequences
    size: np.ndarray  # tokens in each sequence of the pattern
    whole: np.ndarray  # sequences of the pattern that stay; later ones are taken apart
    stream: np.ndarray  # where the first sequence that is taken apart begins in the stream of spare tokens
    gap_at: np.ndarray  # where a receiver's part of the stream begins
    gap: np.ndarray  # tokens that each of its sequences takes
    gap_seq: np.ndarray
    gap_offset: np.ndarray


def padding(size: np.ndarray | int, capacity: int = CAPACITY) -> np.ndarray:
    """Padding of sequences of ``size`` tokens: up to the capacity, but none at a power of two."""
    size = np.asarray(size, np.int64)
    return np.where(size & (size - 1) == 0, 0, capacity - size)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, top_up: bool = True) -> Plan:
    """Patterns of ``counts`` as ``Plan``. With ``top_up`` the emptiest sequences are taken apart, as few as will do:

    their tokens, one after the other, fill the room of all others, and what is left makes sequences of powers of two.
    """
    patterns = sorted(shortest_pack_first(counts, capacity), key=lambda p: p[1])
    open_ = [i for i, (_, room, _) in enumerate(patterns) if top_up and padding(capacity - room, capacity) > 0]
    kept = [n for n, _, _ in patterns]
    gaps, spare = sum(patterns[i][0] * patterns[i][1] for i in open_), 0
    for i in reversed(open_):  # each that is taken apart gives its tokens and no longer has room to fill
        n, room, _ = patterns[i]
        take = min(n, -(-(gaps - spare) // capacity)) if gaps > spare else 0
        kept[i] -= take
        gaps, spare = gaps - take * room, spare + take * (capacity - room)
    seq, stream, slots, receivers = 0, 0, [], []
    first_rank: dict[int, int] = dict.fromkeys(counts, 0)
    for (n, room, held), whole in zip(patterns, kept, strict=True):
        at = 0
        for length, copies in held:
            slots.append((length, first_rank[length], copies, seq, at, capacity - room, whole, stream))
            first_rank[length] += n * copies
            at += length * copies
        if top_up and whole and padding(capacity - room, capacity) > 0:
            receivers.append((room, whole, seq, capacity - room))
        seq, stream = seq + n, stream + (n - whole) * (capacity - room)
    gap_at, table = 0, []
    for room, whole, own, offset in receivers:
        table.append((gap_at, room, own, offset))
        gap_at += room * whole
    left = stream - gap_at
    for bit in reversed(range(max(left, 0).bit_length())):
        if left >> bit & 1:
            table.append((gap_at, 1 << bit, seq, 0))
            gap_at, seq = gap_at + (1 << bit), seq + 1
    s = np.array(slots or np.zeros((0, 8)), np.int64).T
    g = np.array(table or np.zeros((0, 4)), np.int64).T
    key = (s[0] << 44) | s[1]
    order = np.argsort(key)
    return Plan(key[order], s[1][order], s[0][order], *(x[order] for x in s[2:]), *g)


def places(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start in it, part's length, sequence, offset): one part for most pieces, several where a piece fills room of others."""
    k = np.searchsorted(plan.key, (length << 44) | rank, "right") - 1
    own = rank - plan.rank[k]
    number, copy = own // plan.copies[k], own % plan.copies[k]
    offset = plan.at[k] + copy * length
    apart = number >= plan.whole[k]
    stay = np.flatnonzero(~apart)
    out = [(stay, np.zeros(len(stay), np.int64), length[stay], plan.seq[k][stay] + number[stay], offset[stay])]
    begin = plan.stream[k] + (number - plan.whole[k]) * plan.size[k] + offset
    for i in np.flatnonzero(apart).tolist():
        x, end = int(begin[i]), int(begin[i] + length[i])
        first, r = x, int(np.searchsorted(plan.gap_at, x, "right")) - 1
        while x < end:
            if r + 1 < len(plan.gap_at) and x >= plan.gap_at[r + 1]:
                r += 1
            gap = int(plan.gap[r])
            n, inside = divmod(x - int(plan.gap_at[r]), gap)
            size = min(gap - inside, end - x)
            out.append(tuple(np.array([v], np.int64) for v in (i, x - first, size, plan.gap_seq[r] + n, plan.gap_offset[r] + inside)))
            x += size
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Rows of pieces with their ids (two bytes each if all fit), the task that made them, and their number there among those of their length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = ("doc_id", "start", "length", "doc_tokens", "ids_crc32", "part", "local", "wide", "ids")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        for batch in slices(batches):
            out = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder(tokenizer).encode(batch["text"].to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                wide = bool(ids.max() >> 16)
                for s in range(0, len(ids), capacity):
                    own = ids[s : s + capacity]
                    out.append((doc, s, len(own), len(ids), zlib.crc32(own.tobytes()), part, seen[len(own)], wide, own.astype("<u4" if wide else "<u2").tobytes()))
                    seen[len(own)] += 1
            if out:
                yield pa.record_batch({k: pa.array(x, t) for k, x, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    shape = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, part int, local long, wide boolean, ids binary"
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, shape)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, top_up: bool = True) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece of ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; longer ones than ``capacity`` are cut there, and ``top_up`` cuts about one piece for each
    sequence that would be padded (without it nothing else is cut). Sequences are gapless from offset 0.

    Ranks need no sort and no shuffle: each task numbers its own pieces of a length, and sums over tasks (a row for each
    task and length) say where its numbers begin; they are broadcast when they are counted to be small. So a length
    that a third of all documents have is no hot key. Null text is empty (only the end id); texts of any length are taken
    whole; each row is packed, also if it repeats a doc_id or has none; equal lengths are ranked by task and place; an
    empty table gives no rows; columns other than doc_id and text aren't read.
    """
    pieces = keep(_pieces(docs, tokenizer, end_id, capacity), "packing-pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    held = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most a row for each length up to the capacity
    plan = make_plan(held, capacity, top_up)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begin = counts.select("part", "length", F.coalesce(before, F.lit(0)).cast("long").alias("first"))
    ranked = pieces.join(small(begin, counts.count(), 24), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            column = lambda c, b=batch: b[c].to_numpy(zero_copy_only=False)
            piece, start, size, seq, offset = places(plan, column("length"), column("first") + column("local"))
            crc = column("ids_crc32")[piece]
            for j in np.flatnonzero(size < column("length")[piece]).tolist():
                i, s = int(piece[j]), int(start[j])
                ids = np.frombuffer(batch["ids"][i].as_buffer(), "<u4" if batch["wide"][i].as_py() else "<u2")
                crc[j] = zlib.crc32(ids[s : s + int(size[j])].astype("<u4").tobytes())
            doc = batch["doc_id"].take(pa.array(piece))
            yield pa.record_batch({"doc_id": doc, "start": column("start")[piece] + start, "length": size, "ids_crc32": crc, "doc_tokens": column("doc_tokens")[piece], "sequence_id": seq, "offset": offset})

    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "wide", "ids", "local", "first").mapInArrow(place, shape)
