"""The packing by histogram, the periodic runs and the spelling groups against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from docspark.llm import histogram_packing, passages, periodic_runs, spelling_groups
from docspark.llm.shared_keys import pack_keys
from docspark.llm.shingles import shingles, word_hashes

tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = tokenizers.path("byte_bpe_50k.json")


def brute_runs(x):
    """(start, length, period) of all runs, by comparing each word with the one a period later."""
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        same = [x[i] == x[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            j = i
            while same[j]:
                j += 1
            own = x[i : j + q]
            if j > i and len(own) >= max(24, 3 * q) and not any(own[d:] == own[:-d] for d in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def told(doc, words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(kept))


def repeating_texts(seed):
    rng, out = random.Random(seed), []
    for _ in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            letters, period = rng.choice(["ab", "abc", "abcdefghijklmnop"]), rng.choice([1, 2, 3, 6, 7, 8, 9, 15, 16, 17, 32, 40, 70])
            block = [rng.choice(letters) * rng.randint(1, 2) for _ in range(period)]
            words += (block * 12)[: rng.randint(period, 6 * period + 20)]
            words += [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        out.append("".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in words))
    return out + ["", None, "   ", "a", "x " * 23, "x " * 24, "a\xa0a " * 30, "\x1fé " * 40, "one two " * 600 + "end " * 3000]


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_against_brute_force(spark, seed):
    rows = [(i, t, 1, "s", b"x") for i, t in enumerate(repeating_texts(seed))]
    frame = spark.createDataFrame(rows, "doc_id int, text string, period int, tile string, row binary").repartition(3)
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {tuple(r[c] for c in names) for r in periodic_runs.periodic_runs(frame).collect()}
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    assert got == {told(i, split(t)) for i, t, *_ in rows}
    dropped = periodic_runs.drop_repetitions(frame)
    assert dropped.columns == frame.columns and dropped.count() == len(rows)
    assert dropped.where("text is null").count() == 1


def test_runs_of_repeated_and_null_ids(spark):
    text = "a b c " * 20
    rows = [(1, text), (1, "q w e r t " * 12), (None, text), (None, None)]
    got = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.n_runs, r.period or 0) for r in got.collect()) == [(0, 0, 0), (0, 1, 3), (1, 1, 3), (1, 1, 5)]
    assert got.where("doc_id is null").count() == 2
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_words():
    words = [b"%d" % i for i in range(100)]
    doc = next(i for i in range(100) if zlib.crc32(b"%d" % i) % 10 == 0)
    g = zlib.crc32(b"%d" % doc) // 10
    a = g % 100
    p = 1 + (100 - a) // (3 + g % 8)
    assert periodic_runs.planted(doc, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert periodic_runs.planted(doc, []) == [] and periodic_runs.planted(None, words) == words


def test_a_very_long_text_of_runs(spark):
    rng = random.Random(3)
    block = [f"w{rng.randint(0, 5000)}" for _ in range(30_000)]
    words = block * 3 + ["z"] * 50_000 + [f"v{i}" for i in range(100_000)]
    got = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 90_000, 30_000), (90_000, 50_000, 1)]
    assert got.collapsed.split() == block + ["z"] + words[140_000:]


def test_z_function_and_octaves():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randint(0, 1) for _ in range(rng.randint(0, 30))]
        assert periodic_runs.z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
    covered = [q for low, end, _, _ in periodic_runs.octaves(1000) for q in range(low, end)]
    assert covered == list(range(1, len(covered) + 1)) and len(covered) >= 1000
    for low, end, spacing, window in periodic_runs.octaves(1000):
        assert all(max(24 - q, 2 * q) >= spacing == 2 * window for q in range(low, end))


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(rows, every):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            i = h % len(low)
            n[low[:i] + low[i + 1 :] if h % every == 0 else low] += 1
    words = sorted(w for w in n if len(w) >= 5 and n[w] >= 3)
    forms, out = {}, {}
    for w in words:
        them = [v for v in words if near(v, w)]
        best = min(them, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = len(them)

    def root(w):
        return root(forms[w]) if forms[w] else w

    return {(w, forms[w], root(w), n[w], out[w], n[forms[w]] if forms[w] else None) for w in words}


@pytest.fixture(scope="module")
def spelt():
    rng = random.Random(6)
    base = ["".join(rng.choices("abcéÀd", k=rng.randint(4, 8))) for _ in range(40)]
    rows = []
    for doc in range(300):
        words = rng.choices(base, [1 / (i + 1) for i in range(40)], k=30)
        for i in range(0, 30, 3):
            w, at = words[i], rng.randrange(len(words[i]))
            words[i] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aÿZ") + w[at + 1 :], w[:at] + w[at] + w[at:], w])
        rows.append((doc, rng.choice([" ", ", ", "1"]).join(words)))
    return rows + [(7, rows[7][1]), (None, rows[3][1]), (400, None), (401, ""), (402, "ab×cd÷ef ab×cd÷ef AB×cd÷ef ĀaaaaĀ")]


@pytest.mark.parametrize("every", [7, 97])
def test_spelling_against_brute_force(spark, spelt, every):
    frame = spark.createDataFrame([(*r, 1, "x") for r in spelt], "doc_id int, text string, n int, word string").repartition(4)
    got = {tuple(r) for r in spelling_groups.spelling_groups(frame, every).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute_forms(spelt, every)
    assert got == want and any(f for _, f, *_ in want)


def test_spelling_of_nothing_and_of_chains(spark):
    assert spelling_groups.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb"]
    rows = spark.createDataFrame([(w, 3 * 2**i) for i, w in enumerate(chain)], "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling_groups.spelling_forms(rows).collect()}
    assert got["aaaaa"] == ("aaaab", "bbbbbb", 1) and got["bbbbbb"] == (None, "bbbbbb", 1) and got["aaabb"] == ("aabbb", "bbbbbb", 2)


@pytest.mark.parametrize("top_up", [True, False])
def test_histogram_packing(spark, top_up):
    from tokenizers import Tokenizer

    rng = random.Random(7)
    texts = [" ".join(rng.choices(["one", "two", "naïve", "token", "\n", "x9"], k=rng.choice([0, 1, 5, 100, 900, 3000]))) for _ in range(150)]
    rows = [(i, t, 5) for i, t in enumerate([*texts, "", None, "word " * 40_000])] + [(3, texts[3], 5), (None, "a b", 5)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, length int").repartition(3)
    got = histogram_packing.pack_documents(frame, TOKENIZER, 1, top_up=top_up).collect()
    library = Tokenizer.from_file(TOKENIZER)
    want, have = Counter(), defaultdict(list)
    for doc, text, _ in rows:
        want[doc] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    for r in got:
        have[r.doc_id].append(r)
    assert {d: sum(r.length for r in rs) for d, rs in have.items()} == want
    for doc, text, _ in rows:
        if doc in (None, 3):
            continue
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(have[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    sizes = np.array(list(ends.values()))
    padded = int(histogram_packing.padding(sizes).sum())
    assert sizes.max() <= 2048 and (padded == 0 or not top_up)
    assert histogram_packing.pack_documents(frame.limit(0), TOKENIZER, 1).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 2048])
    counts = Counter(rng.choice([rng.randint(1, capacity), 1, capacity]) for _ in range(rng.choice([1, 40, 3000])))
    patterns = histogram_packing.shortest_pack_first(counts, capacity)
    assert len(patterns) <= 2 * len(counts)
    plan = histogram_packing.make_plan(counts, capacity)
    length = np.array([k for k, n in counts.items() for _ in range(n)])
    rank = np.array([r for n in counts.values() for r in range(n)])
    piece, start, size, seq, offset = histogram_packing.places(plan, length, rank)
    assert (np.bincount(piece, size, len(length)) == length).all()
    order = np.lexsort((offset, seq))
    new = np.diff(seq[order], prepend=-1) != 0
    ends = offset[order] + size[order]
    assert (offset[order] == np.where(new, 0, np.append(0, ends[:-1]))).all()
    assert histogram_packing.padding(ends[np.append(new[1:], True)], capacity).sum() == 0


def test_columns_of_the_queries(spark):
    from docspark.llm import queries

    tables = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    runs = queries.op13_periodic_runs(spark, tables)
    assert runs.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] and runs.count() == n
    assert dict(runs.dtypes)["exponent_milli"] == "bigint"
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    split = lambda d: [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w]
    short = [d for d in docs if len(d.text or "") < 4000]
    want = {told(d.doc_id, [w.decode() for w in periodic_runs.planted(d.doc_id, split(d))]) for d in short}
    assert want <= {tuple(r) for r in runs.collect()} and sum(1 for r in want if r[1]) > 5
    forms = {tuple(r) for r in queries.op11_spelling_groups(spark, tables).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    n_words = Counter()
    for d in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            low = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{d.doc_id}:{low}".encode())
            i = h % len(low)
            n_words[low[:i] + low[i + 1 :] if h % 97 == 0 else low] += 1
    assert {(w, k) for w, _, _, k, _, _ in forms} == {(w, k) for w, k in n_words.items() if len(w) >= 5 and k >= 3}


def passage_pair(rng):
    """Two texts around a passage of which one had words changed, inserted and deleted and blocks swapped, with phrases that repeat."""
    n, most = rng.randint(50, 90), rng.choice([10**6, 10**6, 12])
    one = [str(rng.randint(0, most)) for _ in range(n)]
    if rng.random() < 0.3:
        one[20:28] = one[40:48] = one[:8]
    two = list(one)
    for _ in range(rng.randint(0, n // 30)):
        kind, i = rng.random(), rng.randrange(len(two))
        if kind < 0.4:
            two[i] = f"x{rng.random()}"
        elif kind < 0.6:
            two.insert(i, f"y{rng.random()}")
        elif kind < 0.8:
            del two[i]
        else:
            i, j = sorted((i, rng.randrange(len(two))))
            h = rng.randint(i, j)
            two = two[:i] + two[h:j] + two[i:h] + two[j:]
    noise = lambda: [f"n{rng.random()}" for _ in range(rng.randint(0, 15))]
    return " ".join(noise() + one + noise()), " ".join(noise() + two + noise())


def any_passage(x, y):
    """Whether any two windows of 46 shingles or more are similar enough."""
    for s in range(len(x) - passages.WIDTH + 1):
        for e in range(s + passages.WIDTH, len(x) + 1):
            own = set(x[s:e])
            for t in range(len(y) - passages.WIDTH + 1):
                both, other = 0, set()
                for k in range(t, len(y)):
                    if y[k] not in other:
                        other.add(y[k])
                        both += y[k] in own
                    if k - t + 1 >= passages.WIDTH and both >= 0.8 * (len(own) + len(other) - both) - 1e-9:
                        return True
                    if len(other) - both > 0.25 * len(own) + 1:
                        break
    return False


def test_no_edited_passage_is_lost():
    rng, linked, lost = random.Random(11), 0, 0
    for _ in range(500):
        x, y = (np.maximum(shingles(w), np.uint64(1)) for w in word_hashes(list(passage_pair(rng))))
        if min(len(x), len(y)) < passages.WIDTH:
            continue
        found = passages.matching_passages(x, y)
        for s, e, t, u in found:
            one, two = set(x[s:e].tolist()), set(y[t:u].tolist())
            assert min(e - s, u - t) >= passages.WIDTH and len(one & two) >= 0.8 * len(one | two) - 1e-9
        missed = not found and any_passage(x.tolist(), y.tolist())
        linked, lost = linked + (bool(found) or missed), lost + missed
    assert linked > 400 and lost <= linked // 100


def test_swapped_blocks_are_linked(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    turned = words[60:] + words[:60]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(turned)), (3, "else " * 60)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in passages.passage_links(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def repeated_lines(seed):
    """Shingles of two texts that repeat one line, turned at times, with other words between."""
    rng = random.Random(seed)
    line = [rng.randrange(9) for _ in range(rng.randint(8, 30))]
    for _ in range(2):
        out = []
        for _ in range(rng.randint(6, 14)):
            k = rng.randrange(len(line))
            out += line[k:] + line[:k] if rng.random() < 0.3 else line
            out += [1000 + rng.randrange(10**6) for _ in range(rng.randint(0, 4))]
        yield np.array(out, np.uint64) + np.uint64(1)


def test_ranges_of_repeated_shingles_are_all_compared():
    for seed in (0, 9, 11, 19, 20, 25):
        a, b = repeated_lines(seed)
        found = passages.matching_passages(a, b)
        assert found
        for s, e, t, u in found:
            one, two = set(a[s:e].tolist()), set(b[t:u].tolist())
            assert min(e - s, u - t) >= passages.WIDTH and len(one & two) >= 0.8 * len(one | two) - 1e-9


def test_windows_without_a_shared_anchor_send_no_keys():
    texts = [" ".join(f"w{k}" for k in range(300))]
    (anchors,), (keys,) = passages.run_anchors(texts), passages.window_keys(texts)
    assert len(passages.anchored_keys(texts, [[pack_keys(anchors, 6)]], 6)[0]) == len(keys)
    some = passages.anchored_keys(texts, [[pack_keys(anchors[:1], 6)]], 6)[0]
    assert 0 < len(some) < len(keys) and not len(passages.anchored_keys(texts, [[]], 6)[0])


def test_compact_windows_look_at_sliding_minima_only():
    rng = np.random.default_rng(6)
    for n in (0, 3, 22, 23, 46, 47, 400):
        for high in (4, 1 << 62):
            values = rng.integers(0, high, n).astype(np.uint64) * np.uint64(3) + (np.uint64(1) << np.uint64(61))  # floats can't tell these apart
            values[rng.random(n) < 0.01] = 0
            v, want = values.tolist(), []
            for c in range(n):
                left, right = c, c
                while left and v[left - 1] > v[c]:
                    left -= 1
                while right < n - 1 and v[right + 1] >= v[c]:
                    right += 1
                if v[c] and right - left + 1 >= 46:
                    want.append((left, c, right))
            assert [*zip(*(x.tolist() for x in passages.compact_windows(values)), strict=True)] == want


def _passage(a, b):
    """Whether any two ranges of 46 shingles or more are similar, by trying all."""
    number = {x: 1 << k for k, x in enumerate({*a.tolist(), *b.tolist()})}
    sets = []
    for own in (a.tolist(), b.tolist()):
        found = set()
        for s in range(len(own) - 45):
            bits = 0
            for k in range(s, len(own)):
                bits |= number[own[k]]
                if k - s >= 45:
                    found.add(bits)
        sets.append(found)
    return any((x & y).bit_count() >= 0.8 * (x | y).bit_count() - 1e-9 for x in sets[0] for y in sets[1])


def test_bounds_reject_no_passage():
    rng = random.Random(12)
    seen = Counter()
    for _ in range(100):
        vocabulary = rng.choice((2, 6, 10**6, 10**6))
        one = rng.choices(range(vocabulary), k=rng.randint(52, 60))
        if rng.random() < 0.4:
            one = [w for w in one for _ in range(rng.choice((1, 6, 30)))][: rng.randint(52, 66)]
        two = list(one)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(two))
            two[at : at + rng.randint(0, 2)] = [rng.randrange(10**6) for _ in range(rng.randint(0, 2))]
        a, b = (shingles(np.array(x, np.uint64) + np.uint64(1)) for x in (one, two))
        if min(len(a), len(b)) < 46:
            continue
        x, y, codes = passages._coded(a, b)
        n, m = np.bincount(x, minlength=codes), np.bincount(y, minlength=codes)
        common = (n > 0) & (m > 0)
        both = int(common.sum())
        repeats = len(a) + len(b) - int((n > 0).sum()) - int((m > 0).sum())
        rejected = not both or passages._alone(x, y, common, both, 0.8) or int(n @ m) == both and passages._in_order(x, y, common, repeats, 0.8)
        like = _passage(a, b)
        seen[like, bool(rejected)] += 1
        assert not (like and rejected)
    assert seen[True, False] > 20 and seen[False, True] > 10


def test_unlike_texts_of_a_key_are_told_by_bounds(monkeypatch):
    """Runs of repeated words that share one word, and near copies of which every 20th word differs: no stretch of them is tried."""
    monkeypatch.setattr(passages, "_alike", None)
    repeated = [" ".join(w for w in ws for _ in range(20)) for ws in ("a b c d e f", "g h c i j k")]
    plain = [f"w{k}" for k in range(400)]
    changed = [w if k % 20 else f"x{k}" for k, w in enumerate(plain)]
    for one, two in (repeated, (" ".join(plain), " ".join(changed))):
        assert passages.matching_passages(*(s for s, *_ in passages.passage_windows([one, two]))) == []


def test_only_keys_of_many_documents_meet_their_leader(spark, monkeypatch):
    """Documents that are alike in pairs keep no row for each of their keys."""
    rows, seen, given = [], {}, passages.keep
    rng = random.Random(3)
    for i in range(6):
        text = " ".join(str(rng.randrange(10**6)) for _ in range(90))
        rows += [(2 * i, text), (2 * i + 1, f"{text} end{i}")]
    monkeypatch.setattr(passages, "keep", lambda df, name: seen.setdefault(name, given(df, name)))
    got = {r.doc_id: r.class_id for r in passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}
    assert seen["windows"].where("key is not null").count() > 50 and seen["rows"].count() == 0
    plan = passages._led_keys(seen["windows"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_rows_of_a_key_are_compared_by_a_product(monkeypatch):
    rng = np.random.default_rng(13)
    base = rng.integers(1, 1 << 31, (4, 120)).astype(np.uint32)
    rows, label = [], []
    for i in range(60):
        own = base[i % 4].copy()
        own[rng.integers(0, 120, rng.integers(0, 90))] = rng.integers(1, 1 << 31)
        rows.append((i, 0, np.repeat(own[:40], 3) if i % 7 == 0 else own))
        label.append(i % 5)
    label = np.array(label)
    got = [*passages._plausible(rows, label)]
    assert len(got) > 50 and all(i < j and label[i] != label[j] for i, j in got)
    monkeypatch.setattr(passages, "_MOST_ROWS", 1)
    assert [*passages._plausible(rows, label)] == got
    # what the caller finds to belong together isn't paired any more
    monkeypatch.undo()
    seen = []
    for i, j in passages._plausible(rows, label):
        seen.append((i, j))
        label[label == label[j]] = label[i]
    assert len(seen) <= 4
