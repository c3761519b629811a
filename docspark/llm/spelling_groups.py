"""Spelling variants: words that differ by one code point, found in a dictionary of pairs of trie nodes.

The words' prefixes are the nodes of a trie, their suffixes those of the trie of reversed words; both are numbered. A word
is then, at each place, a pair of integers (prefix node, suffix node). A pair that skips a code point equals the pair of
another word that skips one at the same place (replaced), or the unskipped pair of the word without it (deleted or inserted). So
equal pairs are exactly the near words, and no strings are compared.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, keep, slices

LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Distinct words that a task counts before it sends them on.
TASK_WORDS = 200_000
#: Latin-1 bytes: letters as they are, A-Z in lower case, all else a space. A character that Latin-1 lacks is a "?" before.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def checksum(head: int, word: bytes) -> int:
    """crc32 of UTF-8 ``<doc_id>:<word>``; ``head``: that of what stands before the word, which is in Latin-1."""
    return zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)


def word_counts(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """Rows (word, n): the runs of letters (A-Z, a-z, U+00C0 to U+00FF) of all texts, A-Z in lower case, with how often each occurs.

    ``misspell``: a word of a document whose checksum with the doc_id it divides loses one code point: known misspellings to measure against.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = text.encode("latin-1", "replace").translate(_LETTERS).split(b" ")
                held.update(words)
                if misspell:
                    head = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                    for word in set(words):
                        if word and (h := checksum(head, word)) % misspell == 0:
                            i, n = h % len(word), words.count(word)
                            held[word] -= n
                            held[word[:i] + word[i + 1 :]] += n
            if len(held) > TASK_WORDS:
                yield told()
                held.clear()
        yield told()

    texts = bounded(docs).where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def numbered_tries(words: DataFrame) -> DataFrame:
    """``words`` (w, word, n) as rows (w, n, letters, p, s): p[i] is the node of the first i code points, s[i] that of all after them."""
    every = words.select("w", "n", "word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    cut = every.select("w", "n", "word", "i", F.substring("word", F.lit(1), F.col("i")).alias("before"), F.expr("substring(word, i + 1)").alias("after"))
    cut = keep(cut, "trie-places")

    def node(column: str) -> DataFrame:
        # the root, which all words share, has number -1 and takes no part in the join
        return keep(cut.where(F.col(column) != "").select(column).distinct().select(column, F.monotonically_increasing_id().alias(f"{column}_node")), "trie-nodes")

    told = cut.join(node("before"), "before", "left").join(node("after"), "after", "left")
    at = F.struct("i", F.coalesce("before_node", F.lit(-1)).alias("p"), F.coalesce("after_node", F.lit(-1)).alias("s"))
    rows = told.groupBy("w", "n", "word").agg(F.array_sort(F.collect_list(at)).alias("at"))  # a word's length of them
    return rows.select("w", "n", F.split("word", "").alias("letters"), F.col("at.p").alias("p"), F.col("at.s").alias("s"))


def node_pairs(tries: DataFrame) -> DataFrame:
    """Rows (p, s, w, n, skip, first): a word's pairs, unskipped or with a code point skipped; ``first``: not one that follows its like.

    Skipping either of two equal code points in a row gives the same word, so only the first of them counts for deletions.
    """
    at = F.col("i")
    places = tries.select("w", "n", "letters", "p", "s", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    kept = places.select(F.get("p", at).alias("p"), F.get("s", at).alias("s"), "w", "n", F.lit(False).alias("skip"), F.lit(False).alias("first"))
    own = F.coalesce(F.get("letters", at) != F.get("letters", at - 1), F.lit(True))
    return kept.unionByName(places.where(at < F.size("p") - 1).select(F.get("p", at).alias("p"), F.get("s", at + 1).alias("s"), "w", "n", F.lit(True).alias("skip"), own.alias("first")))


def near_words(words: DataFrame) -> DataFrame:
    """Rows (a, b, n): each word of ``words`` (w, word, n) with each word that is near it, and that one's count; each pair once in both orders.

    A pair of nodes has one unskipped word and at most as many skipped ones as there are letters, so no group grows with the input.
    """
    pairs = keep(node_pairs(numbered_tries(words)), "node-pairs")
    one = pairs.where("skip").select("p", "s", F.col("w").alias("a"), F.col("n").alias("an"), F.col("first"))
    two = pairs.select("p", "s", F.col("w").alias("b"), F.col("n").alias("bn"), F.col("skip"))
    met = one.join(two, ["p", "s"]).where("a <> b and (skip or first)")
    # a replaced code point is met from both sides; a deleted one only from the longer word
    both = F.when(F.col("skip"), F.array(F.struct("a", "b", F.col("bn").alias("n")))).otherwise(F.array(F.struct("a", "b", F.col("bn").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("an").alias("n"))))
    return met.select(F.inline(both))


def spelling_forms(counts: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of ``counts`` (word, n), for words of LEAST_LENGTH that occur LEAST_COUNT times.

    A word's form is its near word of the largest n (equal ones: the first in code-point order) if that is FORM_TIMES its own n; its root is
    where forms lead to. Each step doubles the count at least, so by pointer jumping the roots are found in log log rounds.
    """
    some = counts.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    # numbers in the order of the words, so that ties need no text
    words = keep(some.orderBy("word").select(F.monotonically_increasing_id().alias("w"), "word", "n"), "words")
    best = near_words(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("best"))
    found = words.join(best.withColumnRenamed("a", "w"), "w", "left")
    form = F.when(F.col("best.n") >= FORM_TIMES * F.col("n"), -F.col("best.b"))
    state = keep(found.select("w", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form_w")), "forms")
    most = state.agg(F.max("n")).first()[0] or LEAST_COUNT
    steps = math.log(max(most / LEAST_COUNT, 1), FORM_TIMES) + 1
    roots = state.select("w", F.coalesce("form_w", "w").alias("root_w"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        next_ = roots.select(F.col("w").alias("root_w"), F.col("root_w").alias("further"))
        roots = keep(roots.join(next_, "root_w").select("w", F.col("further").alias("root_w")), "roots")
    name = words.select(F.col("w").alias("form_w"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    root = words.select(F.col("w").alias("root_w"), F.col("word").alias("root"))
    out = state.join(roots, "w").join(root, "root_w").join(name, "form_w", "left")
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """``spelling_forms`` of the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; texts of any length are counted whole, a slice at a time; repeated rows count
    again; doc_id only matters with ``misspell`` (null: an empty text there); ties are broken by code points; an
    empty table gives no rows; other columns aren't read.
    """
    return spelling_forms(keep(word_counts(docs, misspell).where(f"n >= {LEAST_COUNT}"), "word-counts"))
