"""Rankings of all documents for questions without a table of their scores: documents and questions lie in blocks, and each look at them scores anew.

A look keeps of a task's blocks what is asked alone: the best documents of each question, the scores of some pairs, or how many documents come
before given ones. So neither what a task holds nor what it sends grows with documents times questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..kept import keep, small_batches

#: Parts of questions that are broadcast, rows that are held until the best of them are chosen, and parts whose counts a task holds at once.
BROADCAST_PARTS, HELD_ROWS, HELD_PARTS = 8, 200_000, 64
NO_ID = -(2**63)
_SCORES = "q long, doc long, score double"


def part_of(q: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(q), F.lit(parts))


def _rows(q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(q), HELD_ROWS):
        own = slice(at, at + HELD_ROWS)
        yield pa.record_batch({"q": pa.array(q[own], pa.int64()), "doc": pa.array(doc[own], pa.int64()), "score": pa.array(score[own], pa.float64())})


def _first(q: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best rows of each question, in order; equal scores (to 6 decimals) by doc."""
    order = np.lexsort((doc, -np.round(score, 6), q))
    start = np.flatnonzero(np.diff(q[order], prepend=q[order[:1]] - 1))
    return order[np.arange(len(q)) - np.repeat(start, np.diff(start, append=len(q))) < k]


def ranks_of(lists: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (q, doc, rank) of ``lists`` (q, them: (s, d) in order), from how many rows (n) of each question have a ``place`` among them.

    A row at a place is behind all listed ones before the place, and isn't behind the one at it.
    """
    told = lists.select("q", F.posexplode("them").alias("place", "x")).join(seen.groupBy("q", "place").agg(F.sum("n").alias("n")), ["q", "place"], "left")
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("q").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return told.select("q", F.col("x.d").alias("doc"), upto.cast("int").alias("rank"))


def places(ts: np.ndarray, td: np.ndarray, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The place of each (s, d) among (ts, td), both by (s, d)."""
    place, end = np.searchsorted(ts, s), np.searchsorted(ts, s, "right")
    at = place.copy()
    while (tied := at < end).any():  # equal scores, by id
        place += tied & (td[np.minimum(at, len(td) - 1)] < d)
        at += 1
    return place


class ScoreBlocks(NamedTuple):
    """``blocks``: rows of documents; ``asked``: part and a part's questions; ``matrices``: of a row of both, (questions, document ids, scores) as
    often as it has blocks, minus infinity where a document isn't ranked. A null id is NO_ID."""

    blocks: DataFrame
    asked: DataFrame
    parts: int
    matrices: Callable[[pa.RecordBatch, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]

    def _look(self, task: Callable[[Iterator], Iterator[pa.RecordBatch]], shape: str, listed: DataFrame | None = None) -> DataFrame:
        """Rows that ``task`` makes of (part, lists, questions, ids, scores); ``listed`` (q, s, d) comes to its question's part as ``lists``, by q, s and d."""
        asked, matrices, alone = self.asked, self.matrices, listed is None
        if listed is not None:
            lists = listed.groupBy(part_of(F.col("q"), self.parts).alias("part")).agg(F.array_sort(F.collect_list(F.struct("q", "s", "d"))).alias("listed"))
            asked = asked.join(keep(lists, "listed"), "part")
        met = small_batches(self.blocks).crossJoin(F.broadcast(asked) if self.parts <= BROADCAST_PARTS else asked)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each() -> Iterator[tuple]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        lists = None if alone else tuple(batch["listed"][i].values.field(c).to_numpy(zero_copy_only=False) for c in ("q", "s", "d"))
                        for found in matrices(batch, i):
                            yield batch["part"][i].as_py(), lists, *found

            return task(each())

        return met.mapInArrow(look, shape)

    def scores(self) -> DataFrame:
        """Rows (q, doc, score): all of them."""

        def task(found: Iterator) -> Iterator[pa.RecordBatch]:
            for _, _, qs, ids, score in found:
                r, c = np.nonzero(score > -np.inf)
                yield from _rows(qs[r], ids[c], score[r, c])

        return self._look(task, _SCORES).withColumn("doc", F.nullif("doc", F.lit(NO_ID)))

    def best(self, k: int) -> DataFrame:
        """Rows (q, doc, score): the ``k`` best (equal ones, to 6 decimals, by doc) of each question and task, and maybe more."""

        def task(found: Iterator) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}  # part: [questions, least scores, rows (place of the question, doc, score), how many are new]

            def cut(own: list) -> None:
                r, d, s = (np.concatenate(x) for x in zip(*own[2], strict=True))
                top = _first(r, d, s, k)
                r, d, s = r[top], d[top], s[top]
                full = np.flatnonzero(np.bincount(r, minlength=len(own[0])) >= k)
                own[1][full] = s[np.searchsorted(r, full, "right") - 1] - 1e-6
                own[2:] = [(r, d, s)], 0

            for part, _, qs, ids, score in found:
                own = held.setdefault(part, [qs, np.full(len(qs), -np.inf), [], 0])
                r, c = np.nonzero((score >= own[1][:, None]) & (score > -np.inf))
                own[2].append((r, ids[c], score[r, c]))
                own[3] += len(r)
                if own[3] >= HELD_ROWS:
                    cut(own)
                if len(held) > HELD_PARTS:
                    yield from told(held, cut)
            yield from told(held, cut)

        def told(held: dict[int, list], cut: Callable[[list], None]) -> Iterator[pa.RecordBatch]:
            for own in held.values():
                cut(own)
                for r, d, s in own[2]:
                    yield from _rows(own[0][r], d, s)
            held.clear()

        return self._look(task, _SCORES).withColumn("doc", F.nullif("doc", F.lit(NO_ID)))

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """Rows (q, doc, rank): the ranks among all documents of ``wanted`` (q, doc), as far as they are ranked.

        One look gives their scores, another one counts for each of them the documents before it.
        """

        def scored(found: Iterator) -> Iterator[pa.RecordBatch]:
            for _, (lq, _, ld), qs, ids, score in found:
                first, last = np.searchsorted(lq, qs), np.searchsorted(lq, qs, "right")
                for r in np.flatnonzero(last > first).tolist():
                    c = np.flatnonzero(np.isin(ids, ld[first[r] : last[r]]) & (score[r] > -np.inf))
                    yield from _rows(np.full(len(c), qs[r]), ids[c], -np.round(score[r, c], 6) + 0.0)

        def counted(found: Iterator) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}
            for part, (lq, ls, ld), qs, ids, score in found:
                first, last = np.searchsorted(lq, qs), np.searchsorted(lq, qs, "right")
                if part not in held:
                    if len(held) == HELD_PARTS:
                        yield from told(held)
                    room = last - first + 1
                    held[part] = (qs, first, last, np.cumsum(room) - room, np.zeros(int(room.sum()), np.int64))
                offset, n = held[part][3:]
                for r in np.flatnonzero(last > first).tolist():
                    c = np.flatnonzero(score[r] > -np.inf)
                    at = places(ls[first[r] : last[r]], ld[first[r] : last[r]], -np.round(score[r, c], 6) + 0.0, ids[c])
                    n[offset[r] : offset[r] + last[r] - first[r] + 1] += np.bincount(at, minlength=last[r] - first[r] + 1)
            yield from told(held)

        def told(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
            for qs, first, last, offset, n in held.values():
                wide = last - first  # what comes after all of a question's is behind none
                r = np.repeat(np.arange(len(qs)), wide)
                place = np.arange(len(r)) - np.repeat(np.cumsum(wide) - wide, wide)
                yield pa.record_batch({"q": pa.array(qs[r], pa.int64()), "place": pa.array(place, pa.int32()), "n": pa.array(n[offset[r] + place], pa.int64())})
            held.clear()

        asked = wanted.where("doc is not null").select("q", F.lit(0.0).alias("s"), F.col("doc").alias("d"))
        pairs = keep(self._look(scored, _SCORES, asked).select("q", F.col("score").alias("s"), F.col("doc").alias("d")), "wanted")
        seen = self._look(counted, "q long, place int, n long", pairs).where("n > 0")
        return ranks_of(pairs.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("s", "d"))).alias("them")), seen)
