import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from docspark.llm import packing, toxicity  # noqa: E402
from docspark.llm.common import keep  # noqa: E402
from docspark.llm.queries import tokenizer_path  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    plain = [f"calm{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(plain, k=14))) for i in range(4)] + [(9, None)]
    texts = [" ".join([*rng.choices(plain, k=rng.randint(1, 90)), *(["idiot"] if i % 5 == 0 else [])]) for i in range(200)]
    texts += ["", None, " ", texts[1], texts[1].replace(" ", "\t"), texts[2] + " tail", f"say {items[0][1]} here", " ".join(items[1][1].split()[2:12])]
    near = texts[3].split()
    texts += [" ".join([*near, f"more{k}"]) for k in range(6)] + ["long " * 9000]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as lang", "'s' as source", "cast(length(text) as long) as n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def kept_toxicity(spark, docs, rows, folder):
    scored = toxicity.score_texts(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {r.doc_id for r in scored.where("score < 0.5").collect()}
    assert kept == {i for i, t in rows.items() if "idiot" not in (t or "").split()}  # the word that the labels follow
    return kept


def kept_exact(spark, docs, rows, folder):
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    return set(first.values())


def kept_near(spark, docs, rows, folder):
    sets, up = {i: shingle_set(t) for i, t in rows.items()}, {i: i for i in rows}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and up[i] != up[j]:
                low, gone = min(up[i], up[j]), {up[i], up[j]}
                up = {k: low if x in gone else x for k, x in up.items()}
    return {i for i in rows if up[i] == i}


def kept_clean(spark, docs, rows, folder):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = words(r.text)
        for s in range(max(1, len(w) - 9)) if w else ():
            windows[len(w[s : s + 10])].add(tuple(w[s : s + 10]))
    hit = lambda w: any(tuple(w[k : k + n]) in of for n, of in windows.items() for k in range(len(w) - n + 1))
    return {i for i, t in rows.items() if not hit(words(t))}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES, (kept_toxicity, kept_exact, kept_near, kept_clean), strict=False):
        rows = {r.doc_id: r.text for r in docs.collect()}
        want = expected(spark, docs, rows, folder)
        docs = keep(stage(spark, docs, folder), "stage")
        assert docs.columns == columns, name
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got == {i: rows[i] for i in want} and len(got) < len(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    tool = Tokenizer.from_file(tokenizer_path())
    tool.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for k, n in enumerate(([len(ids) % packing.CAPACITY] if len(ids) % packing.CAPACITY else []) + [packing.CAPACITY] * (len(ids) // packing.CAPACITY)):
            want.append((r.doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start += n
    assert sorted(map(tuple, packed[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(want)
    ran = corpus_pipeline.run(spark, folder).toPandas()
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    for frame in (packed, ran):
        assert set(frame.doc_id) == {r.doc_id for r in docs.collect()}
        for _, piece in frame.sort_values("piece").groupby("doc_id"):
            assert (piece.start == piece.length.cumsum() - piece.length).all()
        for _, rows in frame.sort_values("offset").groupby("sequence_id"):
            assert rows.length.sum() <= packing.CAPACITY and (rows.offset == rows.length.cumsum() - rows.length).all()
    assert packed[pieces].sort_values(pieces[:2]).values.tolist() == ran[pieces].sort_values(pieces[:2]).values.tolist()


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
