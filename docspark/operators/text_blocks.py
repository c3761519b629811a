"""Scores of all documents for given questions without a stored index: documents and questions in blocks, multiplied as matrices.

Documents are read and counted where they lie and never shuffled; what leaves a task are its scores, or the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..kept import keep, small, small_batches
from .inverted_index import B, K1, counted_words, idf, terms
from .score_blocks import NO_ID, ScoreBlocks, part_of

#: Questions of a part, about, documents that are multiplied at once, and documents and terms of a row of them.
BLOCK_QUERIES, BLOCK_DOCS, ROW_DOCS, ROW_TERMS = 512, 256, 4096, 300_000


def text_blocks(docs: DataFrame, questions: DataFrame, item: str = "doc_id", query: str = "item_id") -> ScoreBlocks:
    """The scores of ``docs`` (item, text; ids don't repeat) for questions (query, text) of which they have a term, by the formula of ``inverted_index``."""
    shape = "n long, words long, docs array<long>, sizes array<long>, ends array<long>, terms array<string>, tf array<int>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        for whole in batches:
            if not whole.num_rows:
                continue
            lengths, at = pc.list_value_length(whole["terms"]).to_numpy(), 0
            full = np.flatnonzero(np.diff(np.maximum(np.cumsum(lengths) // ROW_TERMS, 0), append=-1)) + 1
            cuts = sorted({*full.tolist(), *range(ROW_DOCS, whole.num_rows, ROW_DOCS)})
            for to in cuts:
                batch = whole.slice(at, to - at)
                at = to
                found, tf = batch["terms"].flatten(), batch["tf"].flatten()
                sizes, ends = batch["size"].to_numpy(), np.cumsum(pc.list_value_length(batch["terms"]).to_numpy())
                yield pa.record_batch({"n": pa.array([len(sizes)], pa.int64()), "words": pa.array([int(sizes.sum())], pa.int64()), "docs": one(batch["doc"], pa.int64()), "sizes": one(sizes, pa.int64()), "ends": one(ends, pa.int64()), "terms": one(found, pa.string()), "tf": one(tf, pa.int32())})

    known = small_batches(counted_words(docs, item)).withColumn("doc", F.coalesce("doc", F.lit(NO_ID)))
    blocks = keep(known.mapInArrow(pack, shape), "text-blocks", 4)
    n, words = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / n if words else 1.0
    asked = questions.select(F.col(query).cast("long").alias("q"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct()
    wanted = asked.select("term").distinct()
    counted = blocks.select(F.explode("terms").alias("term")).join(small(wanted, 32), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    parts = max(1, -(-questions.count() // BLOCK_QUERIES))
    weighed = asked.join(counted, "term").select(part_of(F.col("q"), parts).alias("part"), "q", "term", idf(n).alias("idf"))
    packed = keep(weighed.groupBy("part").agg(F.collect_list("q").alias("qs"), F.collect_list("term").alias("asked"), F.collect_list("idf").alias("idf")), "questions")

    def matrices(batch: pa.RecordBatch, i: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, sizes, ends, tf, own, qidf = (batch[c][i].values.to_numpy() for c in ("docs", "sizes", "ends", "tf", "qs", "idf"))
        named = batch["asked"][i].values.dictionary_encode()
        qs, of = np.unique(own, return_inverse=True)
        weights = np.zeros((len(named.dictionary), len(qs)))
        weights[named.indices.to_numpy(), of] = qidf
        found = pc.fill_null(pc.index_in(batch["terms"][i].values, value_set=named.dictionary), -1).to_numpy()
        starts = np.append(0, ends)
        for at in range(0, len(ids), BLOCK_DOCS):
            to = min(at + BLOCK_DOCS, len(ids))
            term, doc = found[starts[at] : starts[to]], np.repeat(np.arange(to - at), np.diff(starts[at : to + 1]))
            hit = np.flatnonzero(term >= 0)
            term, doc, f = term[hit], doc[hit], tf[starts[at] : starts[to]][hit]
            shares = np.zeros((to - at, len(weights)))
            shares[doc, term] = f * (K1 + 1) / (f + K1 * (1 - B + B * sizes[at + doc] / mean))
            score = (shares @ weights).T
            score[score <= 0] = -np.inf
            yield qs, ids[at:to], score

    return ScoreBlocks(blocks.select("docs", "sizes", "ends", "terms", "tf"), packed, parts, matrices)


def block_scores(docs: DataFrame, questions: DataFrame, k: int | None = None, item: str = "doc_id", query: str = "item_id") -> DataFrame:
    """Rows (q, doc, score) of ``text_blocks``: all of them, or the ``k`` best (equal ones, to 6 decimals, by doc) of each task."""
    found = text_blocks(docs, questions, item, query)
    return found.scores() if k is None else found.best(k)
