"""Exact search among vectors by cosine, without comparing all pairs: cells around centroids, with a bound for each.

The angle between a query and any member of a cell is at least that to the centroid less the cell's widest angle. So a cell whose
bound is under the k-th best cosine known is skipped, and the result is that of a whole comparison. Vectors and queries go to
tasks in blocks, which are joined by cell and multiplied as matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..kept import keep, small_batches
from .score_blocks import ScoreBlocks, part_of

#: Vectors that centroids are fitted on at most, rounds of that, cells at most.
SAMPLE_ROWS, ROUNDS, MOST_CELLS = 8192, 4, 1024
#: Vectors of a block, queries of one, and vectors that a cell has on average at least: fewer are compared as quickly as they are skipped.
BLOCK_ROWS, BLOCK_QUERIES, CELL_ROWS = 512, 1024, 4096
#: Vectors that a task holds until its blocks are full; beyond that, blocks go as they are.
HELD_ROWS = 65_536
_CLOSE = 2e-6


class VectorCells(NamedTuple):
    """``blocks``: cell, n, ids, data (unit vectors, 64-bit floats), widest; ``centers``: a row for each cell; ``sizes``, ``widest``: of each."""

    blocks: DataFrame
    centers: np.ndarray
    sizes: np.ndarray
    widest: np.ndarray


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that have a direction, these as unit vectors)."""
    x = np.array(column.to_pylist(), float)
    length = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    good = np.flatnonzero(length > 0)
    return good, x[good] / length[good, None] if len(good) else np.zeros((0, 0))


def fit_centers(x: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of ``x`` (unit vectors): a few rounds of moving each to the mean of what is nearest to it."""
    centers = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            own = x[near == c].sum(axis=0)
            if (size := np.linalg.norm(own)) > 0:
                centers[c] = own / size
    return centers


def _sampled(given: DataFrame, cells: int) -> np.ndarray:
    """Centroids of a sample of ``given`` (id, v); a single cell needs none but any vector."""
    rows = given.limit(1) if cells == 1 else given.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    _, x = _units(rows.toArrow()["v"])
    return fit_centers(x, cells) if len(x) else np.zeros((1, 1))


def build_cells(vectors: DataFrame, item: str, column: str = "embedding", cells: int | None = None, block_rows: int = BLOCK_ROWS) -> VectorCells:
    """Cells of ``vectors`` (item, column). Null and zero vectors have no cosine and are left out.

    The centroids are fitted on SAMPLE_ROWS vectors at most (those whose item hashes lowest); every vector is in a cell. They
    only decide how much a search skips.
    """
    given = vectors.select(F.col(item).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
    n = cells or max(1, min(MOST_CELLS, given.count() // CELL_ROWS))
    centers = _sampled(given, n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, float]]] = {}

        def block(cell: int) -> pa.RecordBatch:
            ids, rows, cosines = zip(*held.pop(cell), strict=True)
            wide = float(np.arccos(np.clip(min(cosines), -1, 1)))
            return pa.record_batch({"cell": pa.array([cell], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "ids": pa.array([list(ids)], pa.list_(pa.int64())), "data": pa.array([np.array(rows).tobytes()], pa.binary()), "widest": pa.array([wide])})

        waiting = 0
        for batch in batches:
            good, x = _units(batch["v"])
            if not len(good):
                continue
            cosines = x @ centers.T if len(centers) > 1 else np.full((len(x), 1), -1.0)
            near = cosines.argmax(axis=1)
            for i, c, v, cos in zip(batch["id"].to_numpy()[good].tolist(), near.tolist(), x, cosines.max(axis=1).tolist(), strict=True):
                held.setdefault(c, []).append((i, v.copy(), cos))  # not a view, which would hold the batch
                waiting += 1
                if len(held[c]) == block_rows:
                    waiting -= block_rows
                    yield block(c)
            if waiting > HELD_ROWS:
                for c in [*held]:
                    yield block(c)
                waiting = 0
        for c in [*held]:
            yield block(c)

    blocks = keep(small_batches(given).mapInArrow(deal, "cell int, n long, ids array<long>, data binary, widest double"), "vector-cells", 8)
    sizes, widest = np.zeros(len(centers), np.int64), np.zeros(len(centers))
    for r in blocks.groupBy("cell").agg(F.sum("n").alias("n"), F.max("widest").alias("widest")).collect():  # a row for each cell
        sizes[r["cell"]], widest[r["cell"]] = r["n"], r["widest"]
    return VectorCells(blocks, centers, sizes, widest)


def cell_bounds(cells: VectorCells, queries: DataFrame, k: int, query: str, column: str = "embedding") -> DataFrame:
    """Rows (q, v, cell, bound, near): the highest cosine a member of the cell can have; ``near``: nearest cells with ``k`` members together."""

    full = np.flatnonzero(cells.sizes)
    centers, sizes, widest = cells.centers[full], cells.sizes[full], cells.widest[full]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _units(batch["v"])
            if not len(good) or not len(full):
                continue
            angle = np.arccos(np.clip(x @ centers.T, -1, 1)) if len(centers) > 1 else np.zeros((len(x), 1))
            most = np.cos(np.maximum(0, angle - widest[None, :]))
            order = np.argsort(angle, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            near = np.zeros(order.shape, bool)
            np.put_along_axis(near, order, before < k, axis=1)
            for i, q in enumerate(batch["q"].to_numpy()[good].tolist()):
                m = len(full)
                yield pa.record_batch({"q": pa.array([q] * m, pa.int64()), "v": pa.array([x[i].tobytes()] * m, pa.binary()), "cell": pa.array(full, pa.int32()), "bound": pa.array(most[i]), "near": pa.array(near[i])})

    asked = queries.select(F.col(query).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).where("v is not null")
    return asked.mapInArrow(bounds, "q long, v binary, cell int, bound double, near boolean")


def _multiplied(cells: VectorCells, wanted: DataFrame, parts: int, k: int | None) -> DataFrame:
    """Rows (q, doc, score) of ``wanted`` (q, v, cell) with all members of the cell, or the ``k`` best of each block for each query."""

    def pack(group: pa.Table) -> pa.Table:
        return pa.table({"cell": pa.array([group["cell"][0].as_py()], pa.int32()), "qs": pa.array([group["q"].to_pylist()], pa.list_(pa.int64())), "qdata": pa.array([b"".join(group["v"].to_pylist())], pa.binary())})

    dealt = wanted.select("cell", F.pmod(F.xxhash64("q"), F.lit(parts)).alias("part"), "q", "v")
    packed = dealt.groupBy("cell", "part").applyInArrow(pack, "cell int, qs array<long>, qdata binary")  # BLOCK_QUERIES or so

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, qs, qdata in zip(*(batch[c].to_pylist() for c in ("ids", "data", "qs", "qdata")), strict=True):
                ids, qs = np.array(ids), np.array(qs)
                score = np.frombuffer(qdata).reshape(len(qs), -1) @ np.frombuffer(data).reshape(len(ids), -1).T
                if k is None or k >= len(ids):
                    yield pa.record_batch({"q": np.repeat(qs, len(ids)), "doc": np.tile(ids, len(qs)), "score": score.ravel()})
                    continue
                by_id = np.argsort(ids, kind="stable")
                order = by_id[np.argsort(-np.round(score[:, by_id], 6), axis=1, kind="stable")[:, :k]]
                yield pa.record_batch({"q": np.repeat(qs, k), "doc": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})

    return cells.blocks.select("cell", "ids", "data").join(packed, "cell").select("ids", "data", "qs", "qdata").mapInArrow(multiply, "q long, doc long, score double")


def _parts(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // BLOCK_QUERIES))


def all_cosines(cells: VectorCells, queries: DataFrame, query: str, column: str = "embedding") -> DataFrame:
    """Rows (q, doc, score): every query with every vector, in blocks."""
    return _multiplied(cells, cell_bounds(cells, queries, 1, query, column), _parts(queries), None)


def vector_blocks(vectors: DataFrame, queries: DataFrame, item: str, query: str, column: str = "embedding") -> ScoreBlocks:
    """The cosines of ``vectors`` (item, column) for ``queries`` (query, column), in blocks."""
    cells = build_cells(vectors, item, column, 1, CELL_ROWS)
    parts = _parts(queries)
    units = cell_bounds(cells, queries, 1, query, column).select(part_of(F.col("q"), parts).alias("part"), "q", "v")
    asked = keep(units.groupBy("part").agg(F.collect_list("q").alias("qs"), F.collect_list("v").alias("qdata")), "questions")

    def matrices(batch: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        qs, ids = (batch[c][i].values.to_numpy() for c in ("qs", "ids"))
        asked = np.frombuffer(b"".join(batch["qdata"][i].as_py())).reshape(len(qs), -1)
        x = np.frombuffer(batch["data"][i].as_py()).reshape(len(ids), -1)
        for at in range(0, len(ids), BLOCK_ROWS):
            yield qs, ids[at : at + BLOCK_ROWS], asked @ x[at : at + BLOCK_ROWS].T

    return ScoreBlocks(cells.blocks.select("ids", "data"), asked, parts, matrices)


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "doc"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search_cells(cells: VectorCells, queries: DataFrame, k: int, query: str, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows (q, doc, score, rank) of the ``k`` highest cosines of each query, rows (q, cell, opened) of what was compared for that)."""
    parts = _parts(queries)
    if len(cells.centers) == 1:
        bounds = cell_bounds(cells, queries, k, query, column)
        return _best(_multiplied(cells, bounds, parts, k), k), bounds.select("q", "cell", F.lit(True).alias("opened"))
    bounds = keep(cell_bounds(cells, queries, k, query, column), "cell-bounds")
    first = keep(_best(_multiplied(cells, bounds.where("near"), parts, k), k), "first-cells")
    reached = first.where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    told = bounds.join(reached, "q", "left").withColumn("opened", F.col("near") | F.col("least").isNull() | (F.col("bound") >= F.col("least") - _CLOSE))
    more = _multiplied(cells, told.where("opened and not near"), parts, k)
    return _best(first.select("q", "doc", "score").unionByName(more), k), told.select("q", "cell", "opened")
