"""Ranking of documents for queries. The definitions are this library's own choice of published ones.

Scores are compared rounded to 6 decimals, equal ones by id, so that a ranking doesn't depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..kept import keep, small_batches
from . import inverted_index, text_blocks, vector_cells
from .score_blocks import NO_ID, ScoreBlocks, places, ranks_of

RRF = 60


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", query: str = "query_id", column: str = "embedding") -> DataFrame:
    """Rows (query, item, score, rank): the ``k`` vectors of highest cosine for each of ``queries`` (query, embedding), exactly.

    Cells that can't hold one of them are skipped; see ``vector_cells``. Vectors that are null or zero have no cosine and are left out.
    """
    best, _ = vector_cells.search_cells(vector_cells.build_cells(vectors, item, column), queries, k, query, column)
    return best.select(F.col("q").alias(query), F.col("doc").alias(item), "score", "rank")


def bm25_topk(docs: DataFrame, questions: DataFrame, k: int, item: str = "doc_id", query: str = "item_id") -> DataFrame:
    """Rows (item_id, doc_id, score, rank), as of an index of the questions' terms; see ``inverted_index``.

    Documents without any term of a question aren't ranked for it. Where ids don't repeat, blocks of documents are scored where they lie
    and only the ``k`` best of each task leave it (``text_blocks``).
    """
    if not inverted_index.repeats(docs, item):
        best = inverted_index.ranked(text_blocks.block_scores(docs, questions, k, item, query), k)
        return best.select(F.col("q").alias(query), F.col("doc").alias(item), "score", "rank")
    wanted = questions.select(F.explode(inverted_index.terms(F.col("text"))).alias("term")).distinct()
    return inverted_index.search(inverted_index.build_index(docs, wanted, item), questions, k, query, item)


def bm25_scores(docs: DataFrame, questions: DataFrame, item: str = "doc_id", query: str = "item_id") -> DataFrame | ScoreBlocks:
    """For ``fused_topk``, every document that has a term of a question: blocks where ids don't repeat, else kept rows (q, doc, score)."""
    if not inverted_index.repeats(docs, item):
        return text_blocks.text_blocks(docs, questions, item, query)
    wanted = questions.select(F.explode(inverted_index.terms(F.col("text"))).alias("term")).distinct()
    return keep(inverted_index.all_scores(inverted_index.build_index(docs, wanted, item), questions, query), "scores")


def top_per_query(scores: DataFrame, query: str, item: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 6).desc(), F.col(item)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Reciprocal rank fusion of two rankings with a column rank: score, and in how many of them a row is."""
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    both = one.select(*keys, F.col("rank").alias("r1")).join(two.select(*keys, F.col("rank").alias("r2")), keys, "full")
    return both.select(*keys, "r1", "r2", (share("r1") + share("r2")).alias("score"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, s, d) as one row for each q of a batch."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch]).group_by("q").aggregate([("s", "list"), ("d", "list")])
            yield from table.rename_columns(["q", "own_s", "own_d"]).combine_chunks().to_batches()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (q, place, n): how many of a row's own (s, d) come after so many of ``them``, both by (s, d)."""
    for batch in batches:
        for i in range(batch.num_rows):
            s, d = batch["own_s"][i].values.to_numpy(), batch["own_d"][i].values.fill_null(NO_ID).to_numpy()
            them = batch["them"][i].values
            n = np.bincount(places(them.field("s").to_numpy(), them.field("d").fill_null(NO_ID).to_numpy(), s, d))
            yield pa.record_batch({"q": pa.array([batch["q"][i].as_py()] * len(n), pa.int64()), "place": pa.array(np.arange(len(n)), pa.int32()), "n": pa.array(n, pa.int64())})


def _counted(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (q, doc, rank): the rank among ``scores`` (q, doc, score) of each row of ``wanted`` (a part of them).

    Each row of ``scores`` finds its place among the wanted ones of its question by halving, a batch at a time, and places are counted;
    nothing is sorted as a whole.
    """
    order = F.struct((-F.round("score", 6)).alias("s"), F.col("doc").alias("d"))
    lists = keep(wanted.groupBy("q").agg(F.array_sort(F.collect_list(order)).alias("them")), "wanted")  # as many as candidates
    held = small_batches(scores).select("q", order.alias("o")).select("q", "o.s", "o.d").mapInArrow(_packed, "q long, own_s array<double>, own_d array<long>")
    return ranks_of(lists, held.join(lists, "q").mapInArrow(_placed, "q long, place int, n long").where("n > 0"))


def fused_topk(one: DataFrame | ScoreBlocks, two: DataFrame | ScoreBlocks, k: int) -> DataFrame:
    """Rows (q, doc, score, rank): the ``k`` best by reciprocal rank fusion of two score lists (q, doc, score), as of their whole rankings.

    A document that is under rank RRF + 2 k or so in both lists has less than the k-th of either one, so only those before that
    are candidates. Those that can still be among the best get their exact rank in the other list by counting. Each list is
    read twice and ranked once, cut to the candidates before it is shuffled. Give lists that are kept, or blocks, of which no list is
    made; documents that a list lacks have no share from it.
    """
    depth = math.ceil(2 / (1 / (RRF + k) - 1e-6)) - RRF
    lists = [(x, keep(inverted_index.ranked(x if isinstance(x, DataFrame) else x.best(depth), depth), "candidates")) for x in (one, two)]
    a, b = (top.select("q", "doc", F.col("rank").alias(f"r{i}")) for i, (_, top) in enumerate(lists, 1))
    share = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    both = a.join(b, ["q", "doc"], "full").withColumn("low", share("r1") + share("r2"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low"), "doc"))
    least = both.withColumn("n", place).where(F.col("n") == k).select("q", F.col("low").alias("least"))
    one_rank = F.when(F.col("r1").isNull() | F.col("r2").isNull(), 1 / (RRF + depth + 1)).otherwise(0.0)
    may = keep(both.join(least, "q", "left").where(F.col("least").isNull() | (F.col("low") + one_rank >= F.col("least") - 1e-6)).select("q", "doc", "r1", "r2"), "candidates")
    for i, (scores, _) in enumerate(lists, 1):
        unknown = may.where(F.col(f"r{i}").isNull()).select("q", "doc")
        exact = _counted(scores, scores.join(unknown, ["q", "doc"])) if isinstance(scores, DataFrame) else scores.ranks(unknown)
        exact = exact.withColumnRenamed("rank", "exact")
        may = may.join(exact, ["q", "doc"], "left").withColumn(f"r{i}", F.coalesce(f"r{i}", "exact")).drop("exact")
    return inverted_index.ranked(may.select("q", "doc", (share("r1") + share("r2")).alias("score")), k)


def hybrid_topk(one: Callable[[int], DataFrame], two: Callable[[int], DataFrame], query: str, item: str, k: int, depth: int = 128) -> DataFrame:
    """Rows (query, item, score, rank): the ``k`` best by reciprocal rank fusion of two whole rankings, read only as deep as needed.

    ``one`` and ``two`` give the first so many ranks of each query. An item that one list lacks so far has at most the next rank there; when
    no item can pass the ``k``-th any more and all these have both ranks (or the list has ended), the result is that of the
    whole rankings. Otherwise the depth grows fourfold.
    """
    keys = [query, item]
    while True:
        a, b = one(depth), two(depth)
        long = lambda x, name: x.groupBy(query).agg(F.max("rank").alias(name))
        fused = fuse(a, b, keys).join(long(a, "n1"), query, "left").join(long(b, "n2"), query, "left")
        next_share = lambda n: F.when(F.coalesce(n, F.lit(0)) < depth, 0.0).otherwise(1 / (RRF + 1 + depth))
        missing = lambda r, n: F.when(F.col(r).isNull(), next_share(F.col(n))).otherwise(0.0)
        most = F.col("score") + missing("r1", "n1") + missing("r2", "n2")
        unseen = next_share(F.col("n1")) + next_share(F.col("n2"))
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.round("score", 6).desc(), F.col(item)))
        ranked = keep(fused.select(*keys, "score", most.alias("most"), unseen.alias("unseen"), rank.alias("rank")), "fused")
        in_top = F.col("rank") <= k
        proof = ranked.groupBy(query).agg(
            F.max(F.when(in_top, F.col("most") - F.col("score"))).alias("open"),
            F.min(F.when(in_top, F.col("score"))).alias("least"),
            F.count(F.when(in_top, 1)).alias("n"),
            F.greatest(F.max(F.when(~in_top, F.col("most"))), F.max("unseen")).alias("rest"),
            F.max("unseen").alias("unseen"),
        )
        if proof.where((F.col("open") > 0) | (F.col("rest") > F.col("least") - 1e-6) & (F.col("rest") > F.col("least")) | (F.col("n") < k) & (F.col("unseen") > 0)).isEmpty():
            return ranked.where(in_top).select(*keys, "score", "rank")
        depth *= 4
