import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docspark.llm import decontaminate, exact_dedup, jaccard_join, language_model, packing, passages, pii, suffix_dedup, token_store, toxicity

tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = tokenizers.path("byte_bpe_50k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"Word{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(40)]
    out += [out[0], out[0].replace(" ", "\t ", 3), out[1] + " end", f"before {passage} after", f"other {passage}", passage, "", None, "   ", "a", "x" * 5000, "line of words here\n" * 40, "line of words here\n" * 40]
    near = out[2].split()
    for k in range(12):
        edited = list(near)
        edited[(7 * k) % len(edited)] = f"new{k}"
        out.append(" ".join(edited))
    out += ["mail bob@example.org, host 10.0.0.1 and 300.1.1.1; card 4539 1488 0343 6467; call +1 (736) 555-5010.", "iban DE89 3704 0044 0532 0130 00 \x01 +12"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "s") for i, t in enumerate(texts())]
    # extra columns whose names clash with those used inside
    return spark.createDataFrame(rows, "doc_id long, text string, run int, keys string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_exact(docs, empty):
    got, first, size = by_id(exact_dedup.exact_groups(docs)), {}, Counter()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts()]
    for i, t in enumerate(norm):
        first.setdefault(t, i)
        size[t] += 1
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == {i: (first[t], size[t], first[t] == i) for i, t in enumerate(norm)}
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(texts()[3].split()[5:25])), (2, "word3 word999"), (3, None), (4, "Word5"), (5, texts()[43])], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, items))
    for i, t in enumerate(texts()):
        words, hit, named = WORD.findall((t or "").translate(LOW)), set(), set()
        for r in items.collect():
            w = WORD.findall((r.text or "").translate(LOW))
            for s in range(max(1, len(w) - 9)) if w else ():
                window = w[s : s + 10]
                for k in range(len(words) - len(window) + 1):
                    if words[k : k + len(window)] == window:
                        hit |= set(range(k, k + len(window)))
                        named.add(str(r.item_id))
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256) == (len(words), len(hit), len(named), sha)
    assert decontaminate.contamination(empty, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())


def test_contamination_of_repeated_ids(spark):
    item = " ".join(f"item{k}" for k in range(14))
    held = f"some words {item} and more"
    # written twice; and beside another text that has one term of the window at the same place
    rows = [(1, held), (1, held), (2, held), (2, "other text item0 item1 item2"), (3, "clean text"), (3, "clean text")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, 18, 14, 1, True), (1, 18, 14, 1, True), (2, 5, 14, 1, True), (2, 18, 14, 1, True), (3, 2, 0, 0, False), (3, 2, 0, 0, False)]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {3}


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma alpha y z z z z beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    windows, postings, counts = decontaminate.build_index(rows, items)
    assert {r.doc_id for r in decontaminate.proximity_matches(windows, postings, counts, 1).collect()} == {1, 2}


def test_pii(docs, empty):
    got = by_id(pii.pii_digest(docs))
    n = len(texts())
    assert [got[n - 2][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1]
    assert "iban:5:32" in got[n - 1].spans
    assert got[46].spans == "" and got[46].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.pii_digest(empty).count() == 0


def test_store_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    token_store.write_store(docs, f"{tmp_path}/s", TOKENIZER, 2, 3)
    got, before = by_id(token_store.read_store(spark, f"{tmp_path}/s")), 0
    for i, t in enumerate(texts()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].ids) == (before, ids)
        before += len(ids)
    assert token_store.read_document(spark, f"{tmp_path}/s", 3).collect()[0].ids == got[3].ids
    token_store.write_store(empty, f"{tmp_path}/e", TOKENIZER, 2, 3)
    assert token_store.stored_digests(spark, f"{tmp_path}/e").count() == 0


def test_packing(docs, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)
    pieces = packing.token_pieces(docs, TOKENIZER, 0)
    got = packing.pack(pieces).toPandas()
    assert len(got) == pieces.count() and not got.duplicated(["doc_id", "piece"]).any()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.length.sum() <= 2048 and (rows.offset == rows.length.cumsum() - rows.length).all()
    assert got.sequence_id.nunique() <= packing.lower_bound(got.length.to_numpy(), 2048) + 2
    assert packing.pack(packing.token_pieces(empty, TOKENIZER, 0)).count() == 0


def test_bound_and_cut():
    assert packing.lower_bound(np.array([1100, 1100, 1100]), 2048) == 3
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096) == [(0, 2048), (2048, 2048)]


def test_language_model(docs, empty):
    got, count = by_id(language_model.fit_and_score(docs)), Counter()
    words = {i: [*(t or "").encode().lower().split(), b" "] for i, t in enumerate(texts())}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        assert got[i].n_tokens == len(w) and got[i].n_known == sum(count[x] > 0 for x in w) and got[i].train_tokens == n
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
        assert got[i].score < 0
    assert language_model.fit_and_score(empty).count() == 0


def test_suffix_ranks():
    rng = random.Random(0)
    for _ in range(100):
        s = np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 50))])
        assert np.argsort(suffix_dedup.suffix_ranks(s, 10**9)).tolist() == sorted(range(len(s)), key=lambda i: tuple(s[i:]))


def test_repeats(docs, empty):
    got, first = by_id(suffix_dedup.remove_repeats(docs)), {}
    for i, t in enumerate(texts()):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(raw, gone) if not g)
        assert (got[i].n_removed, got[i].kept_sha256, bytes(got[i].kept)) == (sum(gone), hashlib.sha256(left).hexdigest(), left)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_jaccard(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, up = Counter(), {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = up[i], up[j]
                up = {k: min(a, b) if x in (a, b) else x for k, x in up.items()}
    got = by_id(jaccard_join.jaccard_links(docs))
    assert {i: (r.n_links, r.class_id) for i, r in got.items()} == {i: (links[i], up[i]) for i in sets}
    assert jaccard_join.jaccard_links(empty).count() == 0


def test_passages(docs, empty):
    got = by_id(passages.passage_links(docs))
    assert {got[i].class_id for i in (43, 44, 45)} == {43} and got[43].n_links
    start, end = map(int, got[43].passages.split(":"))  # the passage, perhaps with its neighbours at this similarity
    assert start <= 1 and end >= 71
    assert got[40].class_id == 0 and got[46].n_links == 0
    assert passages.passage_links(empty).count() == 0


def fresh(rng, n):
    return [f"v{rng.randrange(10**9)}" for _ in range(n)]


def test_all_pairs_of_a_passage_key(spark):
    # every document holds both lines, which supply keys; 4 to 6 share a passage that the smallest and the largest don't have
    rng = random.Random(3)
    line, passage = fresh(rng, 60), fresh(rng, 60)
    rows = [(i, " ".join([*fresh(rng, 30), *line, *fresh(rng, 200), *(passage if 4 <= i <= 6 else fresh(rng, 60)), *fresh(rng, 30)])) for i in range(1, 10)]
    rows.append((10, rows[4][1]))
    got = by_id(passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_links for i in range(1, 11)] == [9] * 10
    for i in (4, 5, 6):
        spans = [tuple(map(int, x.split(":"))) for x in got[i].passages.split(",")]
        assert any(s <= 290 and e >= 350 for s, e in spans)


def test_recall_of_bands():
    rng, found = random.Random(4), 0
    for _ in range(400):
        passage = fresh(rng, 94)
        edited = list(passage)
        edited[25], edited[60] = fresh(rng, 2)  # 80 of 100 shingles are common
        a, b = passages.window_keys([" ".join([*fresh(rng, 80), *p, *fresh(rng, 80)]) for p in (passage, edited)])
        found += len(np.intersect1d(a, b)) > 0
    assert 1 - (1 - 0.8**2) ** passages.BANDS >= 0.999 and found >= 398


def test_passage_with_a_repeated_line():
    rng = random.Random(6)
    line = fresh(rng, 20)
    passage = [*fresh(rng, 20), *line, *fresh(rng, 20)]
    one, two = [*fresh(rng, 40), *line, *fresh(rng, 60), *passage, *fresh(rng, 40)], [*fresh(rng, 50), *passage, *fresh(rng, 90)]
    ways = lambda *texts: passages.matching_passages(*(s for s, *_ in passages.passage_windows([" ".join(t) for t in texts])))
    assert ways(one, two) == [(120, 176, 50, 106)] and ways(two, one) == [(50, 106, 120, 176)]
    # a passage that stands twice in one document
    twice = [*fresh(rng, 50), *passage, *fresh(rng, 90), *passage, *fresh(rng, 90)]
    assert ways(twice, two) == [(50, 106, 50, 106), (200, 256, 50, 106)]
    # all maximal stretches, against brute force, with pairs held in small pieces
    passages._MOST_PAIRS, most = 7, passages._MOST_PAIRS
    try:
        for _ in range(50):
            a, b = (np.array([rng.randrange(4) for _ in range(30)], np.uint64) for _ in range(2))
            want = set()
            for i in range(30):
                for j in range(30):
                    if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                        k = next((k for k in range(30 - max(i, j)) if a[i + k] != b[j + k]), 30 - max(i, j))
                        want.add((i, i + k, j, j + k))
            got = passages._alike(a, b)
            assert len(got) == len(want) and set(got) == want
    finally:
        passages._MOST_PAIRS = most


def test_toxicity(spark, docs, empty):
    rng = random.Random(1)
    words = "quiet house river stone paper light garden window".split()
    rows = [(i, " ".join([*rng.choices(words, k=12), "idiot" if i % 4 == 0 else "friend"]), int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    score = lambda t: float(scorer.score(scorer.numbers(t)[None])[0])
    assert score("the 1d10t there") > 0.5 and score("such an i d i o t") > 0.5 and score("iiidiooot") > 0.5 and score("a quiet river") < 0.5
    held = toxicity.score_texts(train.select("doc_id", "text"), train.select("doc_id", "toxic")).where("held_out").toPandas()
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.95
    assert {r.score for r in toxicity.score_texts(docs, train.select("doc_id", "toxic").limit(0)).collect()} == {0.5}
    assert toxicity.score_texts(empty, train.select("doc_id", "toxic")).count() == 0


def test_repeated_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(fresh(rng, 40)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, c), (None, c), (None, a), (1, a)], "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert left == [(1, a), (1, a), (2, b), (3, c)]  # rows alike in both stay together
    near = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in jaccard_join.drop_near_duplicates(docs.where("doc_id is not null or text <> 'x'")).collect())
    assert near == [(-1, a), (-1, c), (2, b)]  # a null doc_id comes first here
    cut = [(r.doc_id, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted((d if d is not None else -1, t) for d, t in cut) == [(-1, a), (-1, c), (1, ""), (1, ""), (2, ""), (2, b), (3, "")]
    assert len(passages.passage_links(docs).collect()) == 4
    assert jaccard_join.jaccard_links(docs).count() == exact_dedup.exact_groups(docs).count() == 7
    for frame in (pii.pii_digest(docs), language_model.fit_and_score(docs), packing.pack(packing.token_pieces(docs, TOKENIZER, 0))):
        assert frame.count() == 7
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.score_texts(docs, labels).count() == 7
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    assert decontaminate.contamination(docs, items).count() == 7


def test_store_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(2, "two"), (None, "none"), (2, "two again"), (1, None)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/s", TOKENIZER, 2, 2)
    got = token_store.stored_digests(spark, f"{tmp_path}/s").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2] and got[1].n_tokens == 1 and got[1].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
    assert token_store.read_document(spark, f"{tmp_path}/s", 2).count() == 2


def test_wide_ids(tmp_path):
    assert token_store.id_bytes(TOKENIZER, 2) == 2 and token_store.id_bytes(TOKENIZER, 70_000) == 4
    with pytest.raises(ValueError):
        token_store.id_bytes(TOKENIZER, 2**32)
    rows = [(1, 0, 3, token_store._serialized(np.array([1, 70_000, 2]), 4))]
    index, width, digest, base = token_store.read_index(token_store.pack_segment(rows, b"\0" * 32, 4))
    assert width == 4 and index["n_tokens"].tolist() == [3]


def library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(TOKENIZER)
    tool.encode_special_tokens = True
    return tool


def test_encoder_equals_the_library(monkeypatch):
    from docspark.llm import tokens

    rng, tool = random.Random(8), library()
    odd = [chr(x) for x in (0x20, 0x09, 0x0A, 0xA0, 0x85, 0x27, 0x41, 0xE9, 0x0663, 0x3042, 0x1F600, 0x301, 0x2028, 0xD7, 0x0)]
    some = ["".join(rng.choices([*odd, "'s", "'ll ", "'re", "word", " 12", "<|endoftext|>"], k=rng.randint(0, 60))) for _ in range(3000)] + [t or "" for t in texts()]
    want = [x.ids for x in tool.encode_batch(some, add_special_tokens=False)]
    for pieces, chars in ((700_000, 1_000_000), (3_000, 2_000), (5, 2_000)):  # remembers all, forgets often, can't remember
        monkeypatch.setattr(tokens, "MEMO_PIECES", pieces)
        monkeypatch.setattr(tokens, "BATCH_CHARS", chars)
        assert [x.tolist() for x in tokens.Encoder(TOKENIZER).encode(some)] == want


def test_packing_by_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 15)
    got = packing.pack(packing.token_pieces(docs, TOKENIZER, 0, 512), 512)
    bound = packing.certificate(got, 512)
    rows, tool = got.toPandas(), library()
    assert bound[0] == rows.sequence_id.nunique() >= bound[1] >= -(-rows.length.sum() // 512)
    for i, t in enumerate(texts()):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        first = len(ids) % 512 or 512
        want = [len(ids)] if len(ids) <= 512 else [first] + [512] * ((len(ids) - first) // 512)
        assert own.piece.tolist() == list(range(len(want))) and own.length.tolist() == want and own.start.tolist() == (np.cumsum(want) - want).tolist()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]


def test_equal_lengths_and_certificate(spark):
    pieces = spark.createDataFrame([(i, 0, 0, 1030, 0) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.certificate(packing.pack(pieces)) == (50, 50)
    half = spark.createDataFrame([(i, 0, 0, 1024, 0) for i in range(51)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.certificate(packing.pack(half)) == (26, 26)


def test_language_model_probabilities(spark):
    rng = random.Random(2)
    # words that follow each other: a model of pairs is better than one of single words
    chain = {f"w{i}": [f"w{(7 * i + k) % 300}" for k in range(3)] for i in range(300)}
    rows = []
    for i in range(500):
        w = [f"w{rng.randrange(300)}"]
        while len(w) < 60:
            w.append(rng.choice(chain[w[-1]]))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = language_model.fit_and_score(docs).where("held_out").toPandas()
    assert out.score.sum() > 0.8 * out.base_score.sum()  # both are negative
    # without any order in it the model isn't much worse than the base
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), 60))) for i, t in rows[:150]], "doc_id long, text string")
    out = language_model.fit_and_score(mixed).where("held_out").toPandas()
    assert out.score.sum() > 1.01 * out.base_score.sum()
    # the probabilities of all one-word texts, of one unknown word, and of the empty text sum to 1 before the end
    vocabulary = [f"w{i}" for i in range(300)] + ["unknown"]
    held = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 7 == 2][: len(vocabulary) + 1]
    asked = spark.createDataFrame(list(zip(held, ["", *vocabulary])), "doc_id long, text string")
    got = {r.doc_id: r.base_score for r in language_model.fit_and_score(docs.unionByName(asked)).where("doc_id >= 10000").collect()}
    end = got[held[0]]
    assert math.isclose(sum(10 ** (got[i] - end) for i in held[1:]) + 10**end, 1, abs_tol=1e-6)


def test_model_table_and_mixture():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 20, (30, 30))
    table = language_model._log_table(*language_model.train_nce(counts, counts))
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-5)
    assert language_model.mixture_weight(np.full((3, 3), 0.1), np.ones((3, 3))) < 0.01
    assert language_model.mixture_weight(np.full((3, 3), 9.0), np.ones((3, 3))) > 0.99


@pytest.mark.parametrize(
    "text,spans",
    [
        ("pay to GB82 WEST 1234 5698 7654 32 now", "iban:7:34"),
        ("pay to GB82 WEST 1234 5698 7654 33 now", ""),  # fails mod-97
        ("his social security number is 123-45-6789 there", "ssn:30:41"),
        ("part 123-45-6789 is sold out", ""),  # no context
        ("ssn 000-45-6789 and 900-12-3456 and 123-00-6789", ""),  # never given out
        ("card 4539 1488 0343 6468", ""),  # fails Luhn
    ],
)
def test_pii_beyond_the_base(spark, text, spans):
    row = pii.pii_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == spans and row.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pii_context_moves_the_score(spark):
    rows = spark.createDataFrame([(1, "call +1 (736) 555-5010"), (2, "see +1 (736) 555-5010")], "doc_id long, text string")
    score = {r.doc_id: r.found[0].score for r in pii.find_pii(rows).collect()}
    assert score[1] > score[2]


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    decoder = toxicity.Decoder(rng.integers(0, 50, (toxicity.LETTERS,) * 3))
    codes = toxicity._letter_table()
    for text in ("1d10t", "a.b-c", "f**l", "xx00y", "!!", "b@@d", "s h 1"):
        best = None
        for path in itertools.product(*decoder.lattice(text)):
            one, two, value = 0, 0, 0.0
            for letter, channel in path:
                value += channel
                if letter:
                    three = int(codes[min(ord(letter), 0x17F)])
                    value += decoder.logs[one, two, three]
                    one, two = two, three
            value += decoder.logs[one, two, 0]
            best = max(best or (value, ""), (value, "".join(letter for letter, _ in path)))
        assert decoder.decode(text) == best[1]


def test_toxic_word_in_a_long_stretch(spark):
    rng = random.Random(1)
    words = "quiet house river stone paper light garden window".split()
    rows = [(i, " ".join([*rng.choices(words, k=12), "idiot" if i % 4 == 0 else "friend"]), int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    for before in range(10, 40, 3):  # wherever the word stands
        stretch = ".".join([*(rng.choice(words) for _ in range(before)), "1d10t", *(rng.choice(words) for _ in range(30))])
        assert float(scorer.score(scorer.numbers(stretch)[None])[0]) > 0.5
    assert float(scorer.score(scorer.numbers("l0ng-" * 20_000)[None])[0]) < 0.5


def test_forest_depth_follows_the_corpus():
    assert jaccard_join.least_depth(0.8, 0.999) == 5 and jaccard_join.recall_at(0.8, 5) >= 0.999 > jaccard_join.recall_at(0.8, 7)


def test_forest_depth_of_corpora(spark):
    rng = random.Random(7)

    def depth(edits):
        rows = []
        for g in range(40):
            base = fresh(rng, 200)
            for k in range(6):
                own = list(base)
                for at in rng.sample(range(200), edits):
                    own[at] = fresh(rng, 1)[0]
                rows.append((len(rows), " ".join(own)))
        signed = jaccard_join.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
        firsts = signed.selectExpr("struct(doc_id as rep, key_a as set) as node", "labels")
        return jaccard_join.adapted_depth(firsts, 0.8, 0.999)

    # the more alike the least similar pairs are, the longer the prefix
    assert jaccard_join.least_depth(0.8, 0.999) == depth(4) < depth(1)


def test_links_depend_on_no_sample(spark, monkeypatch):
    # groups that are far more alike than asked don't lengthen the prefix, by which pairs near the limit would be lost
    rng = random.Random(8)
    rows = []
    for g in range(40):
        base = fresh(rng, 200)
        rows += [(len(rows) + k, " ".join([*base, f"end{k}"])) for k in range(6)]
    depths = []
    given = jaccard_join._candidate_groups
    monkeypatch.setattr(jaccard_join, "_candidate_groups", lambda reps, depth: depths.append(depth) or given(reps, depth))
    got = by_id(jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")))
    assert depths == [jaccard_join.least_depth(0.8, 0.999)]
    assert all(r.n_links == 5 and r.class_id == i // 6 * 6 for i, r in got.items())


def test_links_between_passages_that_matched_others(spark):
    # neighbours in a chain are alike, others aren't; the inner two have both found their outer one when they are to meet
    rng = random.Random(9)
    rows = []
    for chain in range(12):
        own = fresh(rng, 54)
        for k, at in ((0, None), (2, 15), (3, 27), (1, 39)):
            if at:
                own = [*own[:at], *fresh(rng, 1), *own[at + 1 :]]
            rows.append((4 * chain + k, " ".join([*fresh(rng, 60), *own, *fresh(rng, 60)])))
    got = by_id(passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(got[i].class_id == i // 4 * 4 for i in got) >= len(rows) - 4


def test_one_word_repeated(spark):
    rows = [(1, "word " * 20_000), (2, "other " + "word " * 20_000), (3, "line of words here\n" * 5_000), (4, "start " + "line of words here\n" * 4_000)]
    got = by_id(passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].class_id for i in (1, 2, 3, 4)] == [1, 1, 3, 3]


def test_passages_against_brute_force(spark):
    rng = random.Random(11)
    rows, source = [], [fresh(rng, 70) for _ in range(12)]
    for i in range(60):
        passage = list(source[i % 12])
        for at in rng.sample(range(70), i // 12 % 3):
            passage[at] = fresh(rng, 1)[0]
        rows.append((i, " ".join([*fresh(rng, rng.randint(0, 40)), *passage, *fresh(rng, rng.randint(0, 40))])))
    own = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, t in rows for w in [t.split()]}
    linked = Counter()
    got = by_id(passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string")))
    total = found = 0
    for i in own:
        for j in range(i):
            a, b = own[i], own[j]
            alike = any(
                5 * len(x & y) >= 4 * len(x | y)
                for n in (46, 56, 66)
                for x in (set(a[k : k + n]) for k in range(0, len(a) - n + 1, 2))
                for y in (set(b[k : k + n]) for k in range(0, len(b) - n + 1, 2))
                if i % 12 == j % 12
            )
            total += alike
            found += alike and got[i].class_id == got[j].class_id
            linked[i, j] = alike
    assert total > 50 and found >= 0.9 * total
    assert all(got[i].class_id % 12 == i % 12 for i in own)
    for i, r in got.items():
        for s, e in (map(int, x.split(":")) for x in r.passages.split(",") if x):
            assert e - s >= 50


def test_a_megabyte_without_separators(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id int, toxic int")
    words = ["idiot trash", "kind words"]
    rows = [(i, f"{words[(i + 1) % 2]} number {i}") for i in range(8)] + [(20, "acgt" * 250_000), (21, "a-" * 500_000), (22, "abc.def" * 1000)]
    got = by_id(toxicity.score_texts(spark.createDataFrame(rows, "doc_id int, text string"), labels))
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got.values())


def test_joined_words_are_found_as_before():
    plain = re.compile(r"[a-zß-ÿ]+(?:[.\-_*~][a-zß-ÿ0-9@$!]+)+")
    rng = random.Random(8)
    for _ in range(5000):
        text = "".join(rng.choices("abé.-_*~12@! ", k=rng.randint(0, 14)))
        assert toxicity._JOINED.findall(text) == plain.findall(text)


def test_a_log_of_a_hundred_thousand_addresses(spark):
    n = 100_000
    text = "".join(f"10.{i % 256}.{i // 256 % 256}.{i % 300} up\n" for i in range(n))
    got = pii.find_pii(spark.createDataFrame([(1, text), (2, "host 10.0.0.1")], "doc_id long, text string"))
    spans = {r.doc_id: [(s.start, s.end) for s in r.found if s.kind == "ip"] for r in got.collect()}
    want = [m.span() for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if int(m.group().split(".")[-1]) <= 255]
    assert spans[1] == want and spans[2] == [(5, 13)]
