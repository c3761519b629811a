"""Toxic texts: obfuscated words are restored by a noisy-channel decoder, then the restored text is scored."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, slices

#: Labelled rows that the classifier is fitted on at most (those whose doc_id hashes lowest), features of these rows that are kept
#: (those that most separate the labels), rows a feature needs.
FIT_ROWS, FEATURES, LEAST_ROWS = 20_000, 20_000, 4
#: Log odds of a feature in n rows are multiplied by n / (n + SHRINK): rare ones say little.
SHRINK = 8
#: Letters of the character model: a-z, then U+00DF to U+00FF; 0 stands between words, the last for all else.
_EXTRA = 0xDF
LETTERS = 26 + 33 + 2
_OTHER = LETTERS - 1
#: What a symbol may stand for, and the channel's log probabilities. Fixed values.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_~'"
_LEET, _DROP, _REPEAT, _STAY, _WILD = math.log(0.3), math.log(0.25), math.log(0.35), math.log(0.05), math.log(0.15)
#: A letter and, before or after it, a symbol; three equal letters; or letters joined by separators.
_LETTER, _INNER, _AFTER = re.compile("[a-zß-ÿ]"), re.compile("[0-9@$!|+(€£*_~]"), re.compile("[0-9@$€£*_~]")
_TRIPLE, _JOINED = re.compile(r"([a-zß-ÿ])\1\1"), re.compile(r"(?<![a-zß-ÿ])[a-zß-ÿ]++(?:[.\-_*~][a-zß-ÿ0-9@$!]++)++")
_SPACED = re.compile(r"(?<!\S)(?:[a-zß-ÿ0-9@$!][ .\-_*~]){2,}[a-zß-ÿ0-9@$!](?!\S)")
#: Tokens whose features a worker remembers.
MEMO_TOKENS = 300_000
_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@functools.cache
def _letter_table() -> np.ndarray:
    table = np.full(0x180, _OTHER, np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[_EXTRA:0x100] = np.arange(27, 60)
    for c in " \t\n\r\x0b\x0c.,;:!?\"()[]":
        table[ord(c)] = 0
    return table


def letter_codes(chars: np.ndarray) -> np.ndarray:
    """Character codes of lower-case text to letters of the model."""
    return _letter_table()[np.minimum(chars, 0x17F)]


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter triples over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 256):
                codes = letter_codes(np.frombuffer(" ".join(["", *texts[at : at + 256], ""]).lower().encode("utf-32-le"), np.uint32))
                if len(codes) > 2:
                    total += np.bincount((codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:], minlength=LETTERS**3)
        code = np.flatnonzero(total)
        yield pa.record_batch({"code": pa.array(code, pa.int64()), "n": pa.array(total[code], pa.int64())})

    got = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    triples = np.zeros(LETTERS**3, np.int64)
    triples[got["code"].to_numpy()] = got["n"].to_numpy()
    return triples.reshape(LETTERS, LETTERS, LETTERS)


@dataclass
class Decoder:
    """Viterbi decoding of a character lattice under a character model with interpolated triples."""

    triples: np.ndarray
    logs: np.ndarray = field(init=False)
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        t = self.triples.astype(np.float64)
        pairs, single = t.sum(axis=0), t.sum(axis=(0, 1)) + 1
        one = single / single.sum()
        two = (pairs + 20 * one) / (pairs.sum(axis=1, keepdims=True) + 20)
        three = (t + 20 * two[None]) / (t.sum(axis=2, keepdims=True) + 20)
        self.logs = np.log(three)
        self.triples = np.zeros(0)

    def lattice(self, text: str) -> Iterator[list[tuple[str, float]]]:
        """For each character what it may stand for ("" for nothing) and the channel's log probability."""
        for i, c in enumerate(text):
            own = [(c, 0.0)] if c.isalpha() else [(c, _STAY)]
            own += [(letter, _LEET) for letter in LEET.get(c, "")]
            if c == "*":
                own = [("", _DROP), *((letter, _WILD) for letter in "aeiou")]
            elif c in SEPARATORS:
                own = [("", _DROP), (" ", math.log(0.4))]
            if i and c == text[i - 1] and c.isalpha():
                own.append(("", _REPEAT))
            yield own

    @functools.cached_property
    def table(self) -> list[float]:
        return self.logs.ravel().tolist()

    def decode(self, text: str) -> str:
        """The most probable restored form of lower-case ``text``: the Viterbi path through the whole lattice."""
        # a state is the last two letters, as one number; a path is (path before, letter), so that paths share their beginnings
        # and what no state leads back to is freed at once
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        logs, codes = self.table, _letter_table()
        for arcs in self.lattice(text):
            steps = [(letter, channel, int(codes[min(ord(letter), 0x17F)]) if letter else -1) for letter, channel in arcs]
            after: dict[int, tuple[float, tuple]] = {}
            for state, (value, path) in states.items():
                last = state % LETTERS * LETTERS
                for letter, channel, code in steps:
                    if code < 0:
                        to, got, made = state, value + channel, path
                    else:
                        to, got, made = last + code, value + channel + logs[state * LETTERS + code], (path, letter)
                    if to not in after or after[to][0] < got:
                        after[to] = (got, made)
            states = after
        path = max(((value + logs[state * LETTERS], -state, path) for state, (value, path) in states.items()), key=lambda x: x[:2])[2]
        letters = []
        while path:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, part: str) -> list[str]:
        """Words of the restored forms of an obfuscated stretch."""
        form = self.decode(part)
        return [w for one in {form, re.sub(r"(.)\1+", r"\1", form)} for w in _WORD.findall(one)]

    def features(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """Words of a token (or of a spaced-out stretch) and of its restored forms, and their beginnings of 4 to 6 letters (marked by *)."""
        words = set(_WORD.findall(token))
        if spaced or suspect(token):
            words.update(self.restored(token))
        else:
            for found in _JOINED.finditer(token):
                words.update(self.restored(found.group()))
        return (*words, *{w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k})

    def known(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """The same, remembered."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            got = self.memo[token] = self.features(token, spaced)
        return got


def suspect(token: str) -> bool:
    """Whether a token has a symbol among its letters (or after them), or three equal letters in a row."""
    if token.isalpha():
        return _TRIPLE.search(token) is not None
    first = _LETTER.search(token)
    if not first:
        return False
    if _AFTER.search(token, first.end()) or _TRIPLE.search(token):
        return True
    symbol = _INNER.search(token)
    return symbol is not None and _LETTER.search(token, symbol.end()) is not None


def spaced_out(low: str) -> list[str]:
    """Stretches of single letters with a separator between any two."""
    return [found.group() for found in _SPACED.finditer(low)]


def text_features(text: str, decoder: Decoder) -> set[str]:
    """All features of a text: those of its tokens and of its spaced-out stretches."""
    low = text.lower()
    out: set[str] = set()
    for token in set(low.split()):
        out.update(decoder.known(token))
    for part in set(spaced_out(low)):
        out.update(decoder.known(part, True))
    return out


@dataclass
class Scorer:
    decoder: Decoder
    weights: dict[str, float]
    linear: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def evidence(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """The features of a token that speak for the label; remembered, most tokens have none."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) >= MEMO_TOKENS:
                self.memo.clear()
            got = self.memo[token] = tuple(f for f in self.decoder.features(token, spaced) if self.weights.get(f, 0.0) > 0)
        return got

    def forget(self) -> None:
        """Gives the memory of the remembered tokens back; a worker keeps its last function while it waits for tasks."""
        self.memo.clear()
        self.decoder.memo.clear()

    def numbers(self, text: str) -> np.ndarray:
        """Of the features' log odds: the two largest, and the sum of the large ones. A text without any has only zeros."""
        low = text.lower()
        own: set[str] = set()
        for token in set(low.split()):
            own.update(self.evidence(token))
        for part in spaced_out(low):
            own.update(self.evidence(part, True))
        odds = sorted((self.weights[f] for f in own), reverse=True)
        high = [x for x in odds if x > 2]
        first = odds[0] if odds else 0.0
        return np.array([first, high[1] if len(high) > 1 else 0.0, math.log1p(sum(high))])

    def score(self, numbers: np.ndarray) -> np.ndarray:
        x = (numbers - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.linear[:-1] + self.linear[-1], -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (y - p) - 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Character counts over all texts, log odds of features over the labelled training sample, weights of the few numbers.

    A row of ``labels`` counts if its doc_id is in training (crc32 mod 5 isn't 0), toxic is 0 or 1, and no
    other row says otherwise. The sample has at most FIT_ROWS doc_ids.
    """
    decoder = Decoder(character_counts(bounded(docs)))
    agreed = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("z")).where("y = z").select("doc_id", "y")
    sample = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, zero = Counter(), Counter()
        for batch in slices(batches):
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                own = text_features(text, decoder)
                (one if y else zero).update([*own, ""])  # "" counts the texts
        decoder.memo.clear()
        names = [*(one | zero)]
        yield pa.record_batch({"feature": pa.array(names, pa.string()), "ones": pa.array([one[f] for f in names], pa.int64()), "zeros": pa.array([zero[f] for f in names], pa.int64())})

    counted = rows.mapInArrow(count, "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    counted = counted.where(f"ones + zeros >= {LEAST_ROWS}")
    # texts are counted under "", which always comes first here; then the features that most separate the labels
    totals = counted.where("feature = ''").first() or {"ones": 0, "zeros": 0}
    n1, n0 = totals["ones"], totals["zeros"]
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("zeros") + 0.5) / (n0 + 1))
    odds = odds * (F.col("ones") + F.col("zeros")) / (F.col("ones") + F.col("zeros") + SHRINK)
    signal = F.abs(odds) * F.sqrt(F.col("ones") + F.col("zeros"))
    best = counted.where("feature <> ''").select("feature", odds.alias("odds"), signal.alias("signal")).orderBy(F.desc("signal"), "feature").limit(FEATURES).collect()
    scorer = Scorer(decoder, {r["feature"]: r["odds"] for r in best if abs(r["odds"]) > 0.3}, np.zeros(4), np.zeros(3), np.ones(3))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [scorer.numbers(t).tolist() for t in batch["text"].to_pylist()]
            yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "y": batch["y"].cast(pa.int32())})
        scorer.forget()

    got = rows.mapInArrow(measure, "x array<double>, y int").collect()  # at most FIT_ROWS rows of three numbers
    x, y = np.array([r["x"] for r in got]).reshape(-1, 3), np.array([r["y"] for r in got], float)
    if len(y):
        scorer.center, scorer.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        scorer.linear = _logistic((x - scorer.center) / scorer.scale, y)
    return scorer


def score_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    The score depends on the text alone. Null and empty texts get the score of a text without features. Without labels all scores
    are 0.5. Repeated rows are scored each, labels that contradict each other are left out, a null doc_id is in
    training but has no label. An empty table gives no rows; further columns are ignored, whatever their names. Texts of any length are
    scored whole, in time linear in them. The classifier is fitted on FIT_ROWS labelled rows and keeps FEATURES features at most (both
    bound its size); equal weights are told apart by the feature's text. doc_id comes back as long.
    """
    scorer = fit(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([scorer.numbers(t) for t in batch["text"].to_pylist()]).reshape(-1, 3)
            got = scorer.score(x)
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(got), "predicted": pa.array(got >= 0.5).cast(pa.int32())})
        scorer.forget()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return asked.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is under 0.5, with all columns of ``docs``."""
    scorer = fit(docs.select("doc_id", "text"), labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([scorer.numbers(t or "") for t in batch["text"].to_pylist()]).reshape(-1, 3)
            yield batch.filter(pa.array(scorer.score(x) < 0.5))
        scorer.forget()

    return docs.mapInArrow(clean, docs.schema)
