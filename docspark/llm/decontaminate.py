"""Benchmark passages in training texts, by a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import keep, small, text_bytes, without

WINDOW = 10
#: How many of a window's rarest terms have their position lists intersected before the exact comparison.
RAREST = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that isn't in a word. Java and Spark give code points over U+FFFF as one character here.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _low(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order: A-Z lower-cased, ASCII other than letters and digits separates. Null: none."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BETWEEN, " ")), " ")
    return F.filter(parts, lambda w: w != "")


def _raw_words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _BETWEEN)


def n_words(text: Column) -> Column:
    """The number of ``words`` of a text, without making them."""
    given = F.coalesce(text, F.lit(""))
    edge = lambda pattern: given.rlike(pattern).cast("int")
    between = F.size(_raw_words(text)) - edge("^" + _BETWEEN) - edge(_BETWEEN.replace("+", r"\z"))
    return F.when(F.length(given) == 0, 0).otherwise(F.greatest(between, F.lit(0))).cast("long")


def term_postings(docs: DataFrame, terms: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The index: a row (term, doc_id, pos) for each occurrence in ``docs`` of one of ``terms`` (term), whose ``size`` is known."""
    # a text that begins with a separator has an empty first part, which isn't a word: positions then begin at -1
    parts = docs.select("doc_id", _raw_words(F.col("text")).alias("parts"))
    all_words = parts.select("doc_id", F.posexplode("parts").alias("at", "raw"), (F.col("parts")[0] == "").cast("int").alias("lead"))
    found = all_words.where("raw <> ''").select("doc_id", (F.col("at") - F.col("lead")).alias("pos"), _low(F.col("raw")).alias("term"))
    return found.join(small(terms, *size), "term")


def item_windows(items: DataFrame) -> DataFrame:
    """Rows (item_id, win, size, phrase): the distinct windows of WINDOW words; a shorter item is one window."""
    of = items.select("item_id", words(_low(F.col("text"))).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = of.select("item_id", "w", size.alias("size"), F.explode(starts).alias("from"))
    each = each.select("item_id", "size", F.slice("w", F.col("from"), F.col("size")).alias("phrase"))
    return each.distinct().withColumn("win", F.xxhash64("phrase"))


def _chosen(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (win, size, phrase, picked, term, off): the RAREST least frequent positions of each distinct phrase."""
    spread = phrases.select("win", "size", "phrase", F.posexplode("phrase").alias("off", "term"))
    known = spread.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = known.groupBy("win", "size", "phrase").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("all"))
    picked = ranked.select("win", "size", "phrase", F.slice("all", 1, RAREST).alias("all"))
    return picked.select("win", "size", "phrase", F.size("all").alias("picked"), F.explode("all").alias("one")).select(
        "win", "size", "phrase", "picked", F.col("one.term").alias("term"), F.col("one.off").alias("off"), F.col("one.n").alias("n")
    )


def build_index(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, postings, counts), each kept in the shared folder: postings of every term that ``items`` use."""
    windows = keep(item_windows(items), "windows")
    terms = keep(windows.select(F.explode("phrase").alias("term")).distinct(), "terms")
    postings = keep(term_postings(docs, terms, text_bytes(terms, F.col("term"))), "postings")
    counts = keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    return windows, postings, counts


def phrase_matches(docs: DataFrame, windows: DataFrame, postings: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (doc_id, start, win, size): every place where a window's words follow each other in a document.

    The lists of the rarest terms of a window, each moved back by the term's offset, are intersected first; only
    documents with a place in all of them are read again and compared word by word. A window with a term that
    occurs nowhere has no candidates. Hot terms and hot passages are combined per (doc_id, start, window).
    """
    phrases = windows.select("win", "size", "phrase").distinct()
    chosen = keep(_chosen(phrases, counts), "chosen")
    n, width = text_bytes(chosen, F.col("term"))
    terms = chosen.select("term").distinct()
    lists = postings.join(small(terms, n, width), "term", "left_semi")
    placed = lists.join(small(chosen.select("term", "off", "win", "picked"), n, width + 24), "term")
    moved = placed.select("doc_id", (F.col("pos") - F.col("off")).alias("start"), "win", "picked", F.expr("shiftleft(1, off)").alias("bit")).where("start >= 0")
    # a bit for each offset: rows that repeat a doc_id bring a posting more than once
    agreed = moved.groupBy("doc_id", "start", "win", "picked").agg(F.bit_count(F.bit_or("bit")).alias("hits")).where("hits = picked")
    spots = keep(agreed.select("doc_id", "start", "win"), "spots")
    near = docs.join(spots.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", words(_low(F.col("text"))).alias("w"))
    full = spots.join(small(phrases, *text_bytes(phrases, F.array_join("phrase", " "))), "win")
    return near.join(full, "doc_id").where(F.slice("w", F.col("start") + 1, F.col("size")) == F.col("phrase")).select("doc_id", "start", "win", "size")


def proximity_matches(windows: DataFrame, postings: DataFrame, counts: DataFrame, slop: int) -> DataFrame:
    """Rows (doc_id, start, win): places where all words of a window stand within ``slop`` words of where they would.

    The rarest term's places are the candidates; every other term must occur, in any order, at its offset from
    there give or take ``slop``. Places are joined by stretches of slop + 1 words, so no list is crossed whole.
    """
    width = slop + 1
    terms = windows.select("win", F.posexplode("phrase").alias("off", "term"))
    total = windows.select("win", F.size("phrase").alias("need")).distinct()
    first = _chosen(windows.select("win", "size", "phrase").distinct(), counts)
    first = first.groupBy("win").agg(F.min(F.struct("n", "off", "term")).alias("one")).select("win", "one.term", "one.off")
    anchor = postings.join(first, "term").select("doc_id", "win", (F.col("pos") - F.col("off")).alias("start"))
    anchor = anchor.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width) - 1, F.floor(F.col("start") / width) + 1)))
    other = postings.join(terms.distinct(), "term").select("doc_id", "win", "off", (F.col("pos") - F.col("off")).alias("at"))
    other = other.withColumn("cell", F.floor(F.col("at") / width))
    met = anchor.join(other, ["doc_id", "win", "cell"]).where(F.abs(F.col("at") - F.col("start")) <= slop)
    return met.groupBy("doc_id", "win", "start").agg(F.count_distinct("off").alias("got")).join(total, "win").where("got = need").select("doc_id", "start", "win").distinct()


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per doc_id of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``items`` has item_id and text. n_hit counts the words inside any occurrence of a window. Null or empty texts
    have no words and no hits; items without words have no windows. Copies of an item count as items of their own.
    Of rows that repeat a doc_id each gets the row's own n_words and the hits of all of them; rows without a doc_id get no hits. Empty tables give
    no rows, or rows without hits. Further columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    windows, postings, counts = build_index(docs, items)
    found = keep(phrase_matches(docs, windows, postings, counts), "matches")
    hit = found.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hits = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hit"))
    own = found.select("doc_id", "win").distinct().join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win")
    named = own.groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    counted = docs.select("doc_id", n_words(F.col("text")).alias("n_words"))
    joined = counted.join(hits, "doc_id", "left").join(named, "doc_id", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with its columns, without the documents (all rows with their doc_id) that hold a window of a benchmark item."""
    small_docs = docs.select("doc_id", "text")
    windows, postings, counts = build_index(small_docs, items)
    return without(docs, phrase_matches(small_docs, windows, postings, counts), by_text=False)
