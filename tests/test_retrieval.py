"""The inverted index, the vector cells and the exact fusion against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docspark.operators import inverted_index, retrieval, vector_cells


def bm25(texts, question):
    words = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in texts}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for term in set(re.findall("[a-z0-9]+", question.lower())):
        df = sum(term in w for w in words.values())
        for d, w in words.items():
            if tf := Counter(w)[term]:
                out[d] = out.get(d, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=rng.randint(1, 60))).title()) for i in range(400)]
    texts += [(400, None), (401, ""), (402, "... --"), (403, "!w7 w7?"), (404, "w299 " * 50)]
    questions = [(1, "w0 w1 W250"), (2, "w7"), (3, "nothing here"), (4, None), (5, " ".join(vocabulary[::17])), (6, "w299 w299")]
    return texts, questions


def test_index_against_plain_scores(spark, corpus, tmp_path):
    texts, questions = corpus
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id int, text string, range int, term string").repartition(3)
    asked = spark.createDataFrame(questions, "item_id int, text string")
    inverted_index.write_index(inverted_index.build_index(docs, range_docs=8), f"{tmp_path}/index")
    stored = inverted_index.read_index(spark, f"{tmp_path}/index")
    for got in (inverted_index.search(stored, asked, 7), retrieval.bm25_topk(docs, asked, 7)):
        rows = {(r.item_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in got.collect()}
        want = {}
        for q, text in questions:
            scores = bm25(texts, text or "")
            for k, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:7], 1):
                want[q, k] = (d, round(scores[d], 6))
        assert rows == want
    _, open_, every = inverted_index.needed_ranges(stored, asked.where("item_id = 1"), 7)
    assert 0 < open_.count() < every.count()  # ranges without the rare term aren't opened
    terms = stored.postings.where("term = 'w0'").select("doc")
    assert "EqualTo(term,w0)" in terms._jdf.queryExecution().toString()


def test_search_of_nothing(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert inverted_index.search(inverted_index.build_index(docs), none, 3).count() == 0
    assert inverted_index.search(inverted_index.build_index(docs.limit(0)), spark.createDataFrame(corpus[1], "item_id int, text string"), 3).count() == 0


def test_cells_are_skipped_and_results_exact(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(60, 16)) for c in centers])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(4)
    queries = vectors.where("vec_id % 37 = 0 or vec_id > 899").withColumnRenamed("vec_id", "query_id")
    cells = vector_cells.build_cells(vectors, "vec_id", cells=12)
    got, opened = vector_cells.search_cells(cells, queries, 5, "query_id")
    have = {(r.q, r["rank"]): r.doc for r in got.collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and any(v)}
    for q in [i for i in unit if i % 37 == 0 or i > 899]:
        score = {i: round(float(unit[q] @ v), 6) for i, v in unit.items()}
        assert [have[q, k] for k in range(1, 6)] == sorted(score, key=lambda i: (-score[i], i))[:5]
    assert {q for q, _ in have} == {i for i in unit if i % 37 == 0 or i > 899}
    assert opened.where("opened").count() < 0.5 * opened.count()
    assert vector_cells.all_cosines(cells, queries, "query_id").count() == len({q for q, _ in have}) * len(unit)


@pytest.mark.parametrize("sizes", [(400, 300), (400, 4), (3, 2), (0, 50)])
def test_fusion_of_score_lists(spark, sizes):
    rng = np.random.default_rng(5)
    lists = [{q: {int(d): round(float(rng.random()), 2) for d in rng.permutation(500)[:n]} for q in range(3)} for n in sizes]
    frames = [spark.createDataFrame([(q, d, s) for q, own in one.items() for d, s in own.items()], "q long, doc long, score double").repartition(3).cache() for one in lists]
    got = {(r.q, r["rank"]): r.doc for r in retrieval.fused_topk(*frames, 6).collect()}
    for q in range(3):
        score = {}
        for one in lists:
            for k, d in enumerate(sorted(one[q], key=lambda d: (-one[q][d], d)), 1):
                score[d] = score.get(d, 0) + 1 / (60 + k)
        want = sorted(score, key=lambda d: (-round(score[d], 6), d))[:6]
        assert [got[q, k] for k in range(1, len(want) + 1)] == want and (q, len(want) + 1) not in got


def test_searches_keep_their_work_in_the_jvm(spark, corpus):
    docs, asked = spark.createDataFrame(corpus[0], "doc_id int, text string"), spark.createDataFrame(corpus[1], "item_id int, text string")
    plan = inverted_index.search(inverted_index.build_index(docs), asked, 3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_index_deals_documents_once(spark, corpus, monkeypatch):
    """One shuffle of whole documents, none of single postings; rows that repeat an id are one document where their lengths agree."""
    docs = spark.createDataFrame([*corpus[0], (3, "w0 w0 w1"), (3, "w1 w0 w0"), (500, "w0")], "doc_id int, text string")
    seen, given = {}, inverted_index.keep
    monkeypatch.setattr(inverted_index, "keep", lambda df, name: seen.setdefault(name, df) and given(df, name))
    index = inverted_index.build_index(docs, range_docs=8)
    plan = seen["index"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("Exchange\n") == 1
    assert index.postings.where("term = 'w0' and doc = 3").count() == 2  # lengths 3 (twice, as one) and the first text's
    assert inverted_index.repeats(docs, "doc_id") and retrieval.bm25_topk(docs, spark.createDataFrame(corpus[1], "item_id int, text string"), 3).count() > 0


def test_blocks_shuffle_their_best_only(spark, corpus):
    from docspark.operators import text_blocks

    docs, asked = spark.createDataFrame(corpus[0], "doc_id int, text string").coalesce(1), spark.createDataFrame(corpus[1], "item_id int, text string")
    every, best = text_blocks.block_scores(docs, asked), text_blocks.block_scores(docs, asked, 3)
    got = {(r.q, r.doc): round(r.score, 6) for r in every.collect()}
    assert got == {(q, d): round(x, 6) for q, text in corpus[1] for d, x in bm25(corpus[0], text or "").items()}
    assert 0 < best.count() < every.count() / 5


def test_rankings_of_blocks_keep_no_scores(spark, corpus, monkeypatch):
    """Fused from blocks as from lists of all scores; what is kept for it grows with the questions, not with documents times questions."""
    from docspark.operators import score_blocks, text_blocks

    rng = np.random.default_rng(8)
    docs, asked = spark.createDataFrame(corpus[0], "doc_id int, text string").coalesce(1), spark.createDataFrame(corpus[1], "item_id int, text string")
    vectors = spark.createDataFrame([(i, np.round(rng.normal(size=4) * 2).tolist()) for i in range(450)], "doc_id long, embedding array<double>").coalesce(1)
    queries = vectors.where("doc_id between 1 and 6").withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(text_blocks, "ROW_TERMS", 500)
    monkeypatch.setattr(score_blocks, "HELD_ROWS", 300)
    lists = [text_blocks.block_scores(docs, asked), vector_cells.all_cosines(vector_cells.build_cells(vectors, "doc_id"), queries, "item_id")]
    blocks = [retrieval.bm25_scores(docs, asked), vector_cells.vector_blocks(vectors, queries, "doc_id", "item_id")]
    sizes, given = [], retrieval.keep
    for module in (retrieval, score_blocks):
        monkeypatch.setattr(module, "keep", lambda df, name: (kept := given(df, name), sizes.append((name, kept.count())))[0])
    got = {(r.q, r["rank"]): r.doc for r in retrieval.fused_topk(*blocks, 6).collect()}
    assert max(n for _, n in sizes) <= 6 * 2 * 120
    assert got == {(r.q, r["rank"]): r.doc for r in retrieval.fused_topk(*(x.cache() for x in lists), 6).collect()}
    for found, scores in zip(blocks, lists, strict=True):
        rows = [(r.q, r.doc, round(r.score, 6)) for r in scores.collect()]
        ranks = {(r.q, r.doc): r["rank"] for r in found.ranks(scores.where("doc % 3 = 0").select("q", "doc").unionByName(spark.createDataFrame([(2, 10**6)], "q long, doc long"))).collect()}
        for q in {q for q, _, _ in rows}:
            own = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[2], x[1]))
            assert {x[1]: k for k, x in enumerate(own, 1) if x[1] % 3 == 0} == {d: k for (p, d), k in ranks.items() if p == q}


def test_vectors_wait_in_bounded_numbers(spark, monkeypatch):
    monkeypatch.setattr(vector_cells, "HELD_ROWS", 20)
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        cells = vector_cells.build_cells(vectors, "vec_id", cells=4)
        assert cells.blocks.count() > 20 and cells.blocks.agg({"n": "sum"}).first()[0] == 300 == cells.sizes.sum()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_rows_are_kept_in_small_row_groups(spark, corpus):
    import pyarrow.parquet as pq

    from docspark.operators import text_blocks

    rng = np.random.default_rng(10)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)], "vec_id long, embedding array<double>").coalesce(1)
    docs, asked = spark.createDataFrame(corpus[0], "doc_id int, text string").coalesce(1), spark.createDataFrame(corpus[1], "item_id int, text string")
    text_blocks.ROW_TERMS, most = 50, text_blocks.ROW_TERMS
    try:
        tables = [text_blocks.text_blocks(docs, asked).blocks, vector_cells.build_cells(vectors, "vec_id", block_rows=10).blocks]
    finally:
        text_blocks.ROW_TERMS = most
    for table in tables:
        files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in table.inputFiles()]
        assert table.count() > 20 and max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= 8
