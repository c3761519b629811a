"""A log-bilinear language model, trained in numpy by noise-contrastive estimation on counts of the whole corpus."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep, slices
from .shared_keys import parts_for

#: Words that the model knows by themselves: half the root of the number of training tokens, between these two; all others belong to a
#: class. Both bound the model, not what is counted: unigrams and pairs cover the whole corpus.
LEAST_WORDS, MOST_WORDS, PREFIX_CLASSES = 256, 1600, 96
SIZE, NOISE, STEPS, RATE = 32, 16, 160, 0.06
#: Training stops when so many checks in a row, one every CHECK_STEPS, bring nothing on the development texts.
CHECK_STEPS, PATIENCE = 10, 3
#: Stands for the end of a text among the words; no word has a space.
END = b" "
_LN10 = math.log(10)
#: Distinct words after which a task sends its counts on.
FLUSH_WORDS = 400_000
#: Bytes of text in a bucket, which is scored with the counts of its words in memory.
BUCKET_BYTES = 12_000_000


def tokens(text: str) -> list[bytes]:
    """Words between white space (space, U+0009 to U+000D), A-Z lower-cased, and one end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def word_class(word: bytes) -> int:
    """The class of a word that the model doesn't know by itself: by its first two bytes, and whether punctuation ends it."""
    return 2 * (zlib.crc32(word[:2]) % PREFIX_CLASSES) + (word[-1:] in (b".", b",", b";", b":", b"!", b"?"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    """Context vectors, word vectors and biases over ids: 0 the end, then words by themselves, then classes."""

    ids: dict[bytes, int]
    context: np.ndarray
    word: np.ndarray
    bias: np.ndarray
    class_total: np.ndarray  # of each class: training tokens + distinct words + 1
    weight: float = 1.0  # of this model in the mixture with the unigrams
    table: np.ndarray | None = None  # of all ids after each id, once a task has asked for it

    def id_of(self, word: bytes) -> int:
        known = self.ids.get(word)
        return len(self.ids) + word_class(word) if known is None else known

    def log10_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all ids after each of ``contexts``, by one batched matrix product."""
        scores = self.context[contexts] @ self.word.T + self.bias
        top = scores.max(axis=1, keepdims=True)
        return (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / math.log(10)


def _log_table(context: np.ndarray, word: np.ndarray, bias: np.ndarray) -> np.ndarray:
    scores = context @ word.T + bias
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def train_nce(counts: np.ndarray, check: np.ndarray, size: int = SIZE, noise: int = NOISE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context vectors, word vectors, biases) from the counts of (context, word) pairs.

    Noise-contrastive estimation: every CHECK_STEPS steps ``noise`` words are drawn for each token from the unigrams, and the model learns to tell the pairs
    of the corpus from the drawn ones. All pairs take part in each step, as a matrix of counts. Adam steps, fixed seed. The
    parameters that are best for the normalised probability of the pairs in ``check`` are returned.
    """
    n = len(counts)
    rng = np.random.default_rng(11)
    counts = counts.astype(np.float32)
    unigram = (counts.sum(axis=0) + 1) / (counts.sum() + n)
    shift = np.log(noise * unigram).astype(np.float32)
    total = max(float(counts.sum()), 1.0)
    per_row = counts.sum(axis=1, keepdims=True)
    params = [rng.normal(0, 0.1, (n, size)).astype(np.float32), rng.normal(0, 0.1, (n, size)).astype(np.float32), np.log(unigram).astype(np.float32)]
    best, best_value, since = [p.copy() for p in params], -math.inf, 0
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    # a context's n tokens bring noise * n words: so many are drawn for it, split over the words by their unigrams
    drawn_a_row = (noise * per_row[:, 0]).astype(np.int64)
    share = (unigram / unigram.sum()).astype(np.float64)
    for step in range(1, steps + 1):
        if step % CHECK_STEPS == 1:
            drawn = rng.multinomial(drawn_a_row, share).astype(np.float32)
        q, r, b = params
        delta = q @ r.T + (b - shift)
        p_data = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        # a row's gradient is divided by the root of its count: rare contexts learn as well
        g = (counts * (1 - p_data) - drawn * p_data) / np.sqrt(per_row * total / n + 1.0)
        grads = [g @ r - 1e-4 * q, g.T @ q - 1e-4 * r, g.sum(axis=0)]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            pace = RATE * (1 - step / (steps + 1))
            params[i] = params[i] + pace * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        if step % CHECK_STEPS == 0:
            value = float((check * _log_table(*params)).sum())
            best, best_value, since = (params, value, 0) if value > best_value else (best, best_value, since + 1)
            params = [p.copy() for p in params]
            if since == PATIENCE:
                break
    return tuple(best)


def mixture_weight(ratio: np.ndarray, check: np.ndarray) -> float:
    """The model's weight that makes the pairs of ``check`` most probable, by expectation maximisation. ``ratio``: model to unigram probability."""
    weight, total = 0.5, check.sum()
    for _ in range(200 if total else 0):
        weight = float((check * (weight * ratio / (weight * ratio + 1 - weight))).sum() / total)
    return weight


def _word_counts(docs: DataFrame) -> DataFrame:
    """Rows (bucket, word, n): the distinct words of each bucket, with their number in its training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for bucket, counter in seen.items():
                yield pa.record_batch(
                    {"bucket": pa.array(np.full(len(counter), bucket), pa.int32()), "word": pa.array([*counter], pa.binary()), "n": pa.array([*counter.values()], pa.int64())}
                )
            seen.clear()

        for batch in slices(batches):
            for bucket, out, text in zip(batch["bucket"].to_pylist(), batch["held_out"].to_pylist(), batch["text"].to_pylist(), strict=True):
                counter = seen.setdefault(bucket, Counter())
                words = tokens(text)
                counter.update(dict.fromkeys(words, 0) if out else words)
            if sum(map(len, seen.values())) > FLUSH_WORDS:
                yield from told()
        yield from told()

    return docs.mapInArrow(count, "bucket int, word binary, n long")


class _Ids(dict):
    """The ids of words; classes of words that the model doesn't know by themselves are remembered."""

    def __init__(self, ids: dict[bytes, int]):
        super().__init__(ids)
        self.base = len(ids)

    def __missing__(self, word: bytes) -> int:
        self[word] = got = self.base + word_class(word)
        return got


def _pair_counts(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the counts of (word before, word) over all training texts: those that teach, and a fifth for development."""
    n = len(model.bias)
    ids = model.ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * n * n, np.int32)
        memo = _Ids(ids)
        for batch in slices(batches):
            if len(memo) > FLUSH_WORDS:
                memo = _Ids(ids)
            every = [tokens(t) for t in batch["text"].to_pylist()]
            flat = np.array([0, *(memo[w] for words in every for w in words)], np.int64)
            apart = np.repeat(batch["check"].to_numpy(zero_copy_only=False), [*map(len, every)])
            code, seen = np.unique((apart * n + flat[:-1]) * n + flat[1:], return_counts=True)
            total[code] += seen
        for at in range(0, len(total), 1_000_000):
            code = np.flatnonzero(total[at : at + 1_000_000]) + at
            yield pa.record_batch({"code": pa.array(code, pa.int64()), "n": pa.array(total[code], pa.int64())})

    check = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    asked = docs.where("not held_out").select("text", check.cast("int").alias("check")).mapInArrow(count, "code long, n long")
    got = asked.groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # at most two rows for each pair of ids of the model
    matrix = np.zeros(2 * n * n, np.int64)
    matrix[got["code"].to_numpy()] = got["n"].to_numpy()
    return matrix[: n * n].reshape(n, n), matrix[n * n :].reshape(n, n)


def fit_and_score(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every text is scored; texts whose crc32(doc_id) mod 7 isn't 2 are learnt from, all of them: word counts and pair counts
    cover all training tokens. base_score is the unigram score with add-one smoothing; score is the log10 probability of the text
    by the model mixed with the unigrams. The model's part: each word's id after the id before it, times, for a word known by its class,
    its share in the class with add-one smoothing and one share for all words unknown. Its weight is the best for the
    development texts, a fifth of the training texts, which also end its training. All probabilities after a word sum to 1.
    Null texts count as empty: they have only the end. A null doc_id counts as training text. Repeated rows count
    each; without any training text N and V are 0. An empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    parts = parts_for(docs, BUCKET_BYTES, 1)
    bucket = F.pmod(F.xxhash64("doc_id", F.octet_length(text)), F.lit(parts)).cast("int").alias("bucket")
    own = docs.select("doc_id", text.alias("text"), held_out(F.col("doc_id")).alias("held_out"), bucket)
    seen = keep(_word_counts(own.select("bucket", "held_out", "text").repartition(parts, "bucket")), "bucket-words")
    counts = keep(seen.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    train_tokens, distinct = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_words = int(min(MOST_WORDS, max(LEAST_WORDS, math.sqrt(train_tokens) / 2)))
    top = counts.where("c > 0").where(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("c"), "word").limit(n_words).collect()
    ids = {END: 0} | {bytes(r["word"]): i for i, r in enumerate(top, 1)}
    n = len(ids) + 2 * PREFIX_CLASSES
    model = Model(ids, np.zeros((n, SIZE), np.float32), np.zeros((n, SIZE), np.float32), np.zeros(n, np.float32), np.zeros(0))
    pairs, check = _pair_counts(own.select("held_out", "text"), model)
    model.context, model.word, model.bias = train_nce(pairs, check)

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * PREFIX_CLASSES, np.int64)
        for batch in slices(batches):
            for w, c in zip(batch["word"].to_pylist(), batch["c"].to_pylist(), strict=True):
                if c and w not in ids:
                    total[word_class(w)] += c + 1
        yield pa.record_batch({"class": pa.array(range(len(total)), pa.int32()), "n": pa.array(total, pa.int64())})

    sums = counts.mapInArrow(by_class, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect()  # a row a class
    model.class_total = np.ones(2 * PREFIX_CLASSES)
    for r in sums:
        model.class_total[r["class"]] += r["n"]
    log_base = math.log10(train_tokens + distinct + 1)
    # inside a class the unigrams decide in both, so that the ratio of model and unigram hangs on the ids alone
    mass = np.concatenate([[train_tokens and float((pairs + check)[:, 0].sum()) + 1.0], [float(r["c"]) + 1.0 for r in top], model.class_total])
    ratio = np.exp(_log_table(model.context, model.word, model.bias).astype(np.float64)) * (train_tokens + distinct + 1) / np.maximum(mass, 1.0)
    model.weight = mixture_weight(ratio, check)

    def score(_key, texts: pa.Table, words: pa.Table) -> pa.Table:
        order = words["word"].to_pylist()
        c = words["c"].to_numpy().astype(np.float64)
        place = dict(zip(order, range(len(order)), strict=True))
        of = np.fromiter(map(model.id_of, order), np.int64, len(order))
        known = np.log10(c + 1)
        inside = of >= len(model.ids)
        share = np.where(inside, known - np.log10(model.class_total)[np.maximum(of - len(model.ids), 0)], 0.0)
        if model.table is None:
            model.table = model.log10_probabilities(np.arange(len(model.bias)))
        table = model.table
        weight, log_weight = model.weight, math.log10(model.weight) if model.weight else -math.inf
        log_rest = math.log10(1 - weight) if weight < 1 else -math.inf
        rows = []
        for doc, out, text in zip(texts["doc_id"].to_pylist(), texts["held_out"].to_pylist(), texts["text"].to_pylist(), strict=True):
            at = np.fromiter(map(place.__getitem__, tokens(text)), np.int64)
            now = of[at]
            before = np.append(0, now[:-1])
            plain = known[at] - log_base
            one, two = table[before, now] + share[at] + log_weight, plain + log_rest
            mixed = np.logaddexp(one * _LN10, two * _LN10) / _LN10
            rows.append((doc, out, len(at), int((c[at] > 0).sum()), train_tokens, float(plain.sum()), float(mixed.sum())))
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)})

    asked = seen.select("bucket", "word").distinct().join(counts, "word")
    texts = own.select("bucket", "doc_id", "held_out", "text")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(score, shape)
