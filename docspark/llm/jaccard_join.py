"""Documents with much the same word shingles: a MinHash LSH forest, then exact verification.

A label of a tree is the tree's min-hashes one after the other. Labels in order are a prefix trie: its nodes at depth d are the
runs of labels that agree in their first d min-hashes. Documents in one node of any tree are compared. The depth starts at whole
labels and is shortened as far as the target recall asks for at the very limit of similarity: by formula, whatever the corpus is like.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, components, give_back, keep, row_mark, slices, unzipped, without, zipped

#: Trees of the forest and min-hashes in a label. Labels are compared by prefixes of at most DEPTH min-hashes.
TREES, DEPTH = 20, 8
#: Labels in the nodes of the trie that the similarities of the corpus are measured on, about; nodes are taken by their hash, whole.
SAMPLE_LABELS = 20_000
SIMILARITY, TARGET_RECALL = 0.8, 0.999
#: Documents and shingles of a block: two blocks are compared by one task.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 500_000
_NO_ID = -(2**63)


def recall_at(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two documents of this similarity share a prefix of ``depth`` min-hashes in any tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(similarity: float, target: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix by which even pairs that are just at ``similarity`` are found with ``target`` recall."""
    while depth > 1 and recall_at(similarity, depth, trees) < target:
        depth -= 1
    return depth


def _agreements(firsts: DataFrame, depth: int) -> np.ndarray:
    """How many pairs agree in 0, 1, ... of all min-hashes, among labels of sampled nodes of the trie and the first label of their node."""
    part = max(1, firsts.count() * TREES // SAMPLE_LABELS)
    each = firsts.select("node", "labels", F.posexplode("labels").alias("tree", "label"))
    each = each.withColumn("prefix", F.xxhash64("tree", F.substring("label", 1, 4 * depth))).where(F.pmod("prefix", F.lit(part)) == 0)
    each = each.select("node", "prefix", F.concat(*(F.col("labels")[i] for i in range(TREES))).alias("all"))
    heads = each.groupBy("prefix").agg(F.min(F.struct("node", "all")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = each.join(heads, "prefix").where("node <> first.node").select("all", F.col("first.all").alias("other"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TREES * DEPTH + 1, np.int64)
        for batch in slices(batches):
            one, two = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(-1, TREES * DEPTH) for c in ("all", "other"))
            total += np.bincount((one == two).sum(axis=1), minlength=len(total))
        yield pa.record_batch({"agree": pa.array(range(len(total)), pa.int32()), "n": pa.array(total, pa.int64())})

    got = pairs.mapInArrow(count, "agree int, n long").groupBy("agree").agg(F.sum("n").alias("n")).collect()  # a row for each count
    out = np.zeros(TREES * DEPTH + 1)
    for r in got:
        out[r["agree"]] = r["n"]
    return out


def adapted_depth(firsts: DataFrame, similarity: float, target: float) -> int:
    """The longest prefix that finds even the least similar of the corpus' similar pairs with ``target`` recall, never shorter than
    ``least_depth``. ``firsts``: node, labels. A mean over all pairs wouldn't do: very similar ones would outvote those near the limit.
    It describes the sampled nodes only and may pass over the least similar pairs, so ``jaccard_links`` doesn't rely on it.
    """
    least = least_depth(similarity, target)
    agree = np.flatnonzero(_agreements(firsts, least))
    share = agree[agree >= similarity * TREES * DEPTH] / (TREES * DEPTH)
    return least_depth(float(share.min()), target) if len(share) else least


def _coefficients() -> np.ndarray:
    return np.random.default_rng(20_260).integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labels_of(sets: np.ndarray, odd: np.ndarray) -> list[bytes]:
    """The label of each tree: the leading 4 bytes of its min-hashes, so that a prefix of a label is one of the tree."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 4096):
        part = sets[at : at + 4096]
        low = np.minimum(low, (odd[:, None] * part[None, :]).min(axis=1))
    short = (low >> np.uint64(32)).astype(">u4").reshape(TREES, DEPTH)
    return [row.tobytes() for row in short]


def set_key(sets: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a set of shingles."""
    from .shingles import mixed

    a, b = mixed(sets + np.uint64(7)), mixed(sets ^ np.uint64(0x5851F42D4C957F2D))
    return int(np.add.reduce(a).astype(np.int64)), int(np.add.reduce(b).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, run, size, key_a, key_b, labels); those without any word have size 0 and no labels."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingles, word_hashes

        odd = _coefficients()
        for batch in slices(batches):
            rows = []
            for doc, mark, run, words in zip(batch["doc_id"].to_pylist(), batch["mark"].to_pylist(), batch["run"].to_pylist(), word_hashes(batch["text"].to_pylist()), strict=True):
                own = np.unique(shingles(words))
                rows.append((doc, mark, run, len(own), *(set_key(own) if len(own) else (0, 0)), labels_of(own, odd) if len(own) else None))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()))
                names = ("doc_id", "mark", "run", "size", "key_a", "key_b", "labels")
                yield pa.record_batch({k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    asked = bounded(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("doc_id"), row_mark(F.col("text")).alias("mark"), F.spark_partition_id().alias("run"), F.coalesce("text", F.lit("")).alias("text"))
    return asked.mapInArrow(sign, "doc_id long, mark long, run int, size long, key_a long, key_b long, labels array<binary>")


def _candidate_groups(reps: DataFrame, depth: int) -> DataFrame:
    """Rows (node, label): representatives that stand in one node of a trie at ``depth``, connected."""
    each = reps.select("node", F.posexplode("labels").alias("tree", "label"))
    each = each.select("node", "tree", F.xxhash64(F.substring("label", 1, 4 * depth)).alias("prefix"))
    first = each.groupBy("tree", "prefix").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a representative is tied to the smallest of its trees' first members, and these among each other: an edge or so a
    # representative instead of one for each tree
    met = each.join(first, ["tree", "prefix"]).groupBy("node").agg(F.min("first").alias("least"), F.collect_set("first").alias("firsts"))
    tied = met.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(met.select(F.explode("firsts").alias("a"), F.col("least").alias("b")))
    edges = tied.where("a <> b").distinct()
    return components(edges)


def _linked(rows: list[tuple], similarity: Fraction, cross: bool) -> Iterator[tuple[tuple, int, tuple]]:
    """(node, links, smallest connected node) of a block pair's rows (node, side, copies, shingles); links count copies."""
    rows = sorted(rows, key=lambda r: r[0])
    sets = [r[3] for r in rows]
    sizes = np.array([*map(len, sets)], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.diff(flat, prepend=flat[0] ^ np.uint64(1)) != 0
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common = np.zeros((len(rows), len(rows)), np.float32)
    if len(column):
        column = np.cumsum(np.diff(column, prepend=column[0]) != 0)
        width = max(256, 4_000_000 // len(rows))
        cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                block = np.zeros((len(rows), width), np.float32)
                block[owner[a:b], column[a:b] % width] = 1
                common += block @ block.T
    linked = np.zeros(common.shape, bool)
    pieces = [slice(at, at + 256) for at in range(0, len(rows), 256)]  # no whole matrix of wide integers is held
    for own in pieces:
        both = np.rint(common[own]).astype(np.int64)
        linked[own] = both * (similarity.denominator + similarity.numerator) >= similarity.numerator * (sizes[own, None] + sizes[None, :])
    del common
    np.fill_diagonal(linked, False)
    if cross:
        side = np.array([r[1] for r in rows])
        linked &= side[:, None] != side[None, :]
    copies = np.array([r[2] for r in rows], np.int64)
    links = linked @ copies
    label = np.arange(len(rows))
    while True:
        near = np.concatenate([np.where(linked[own], label[None, :], len(rows)).min(axis=1) for own in pieces])
        best = np.minimum(label, near)
        if (best == label).all():
            break
        label = best
    for r, n, to in zip(rows, links.tolist(), label.tolist(), strict=True):
        if n:
            yield r[0], n, rows[to][0]


def jaccard_links(docs: DataFrame, similarity: float = SIMILARITY, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, mark (see ``row_mark``), class_id, n_links, class_rep.

    Two rows are linked if the Jaccard similarity of their sets of five-word shingles is at least ``similarity``
    (shingles are compared by 64-bit hashes). n_links is the number of other rows linked to a row, class_id
    the smallest doc_id that links lead to, class_rep the smallest doc_id with the very same shingles. Rows with fewer
    than five words have one shingle of all of them; null, empty and wordless texts have none and stay alone. A null doc_id
    comes before all others (it is -2**63 inside, so no doc_id may be that). Rows that repeat a doc_id are counted one by one, each
    with the links of its own text. Further columns are ignored, an empty table gives no rows.

    Rows with equal sets are one representative from the start, so copies are never paired. The forest only says
    which representatives may be linked; groups of these are cut into blocks of bounded size and every pair of
    blocks is compared exactly by one task, so that a large group of near copies is spread and loses no link.
    """
    signed = keep(signatures(docs), "signatures")
    keys = ["key_a", "key_b", "size"]
    worded = signed.where("size > 0")
    # equal sets are one node, named by its smallest doc_id and, as rows may repeat a doc_id, by the set's key
    node = F.struct(F.col("doc_id").alias("rep"), F.col("key_a").alias("set"))
    reps = worded.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = keep(reps.withColumn("node", F.struct("rep", F.col("key_a").alias("set"))), "reps")
    first = worded.join(reps.select(*keys, F.col("rep").alias("doc_id")), [*keys, "doc_id"]).dropDuplicates([*keys, "doc_id"])
    firsts = keep(first.select(node.alias("node"), "labels"), "firsts")
    groups = _candidate_groups(firsts, least_depth(similarity, target_recall))
    sized = groups.select("node", F.xxhash64("label").alias("grp")).join(reps, "node")
    blocks = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = sized.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("node")
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("rep"), F.coalesce("text", F.lit("")).alias("text"))
    asked = zipped(texts).join(placed, "rep")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingles, word_hashes

        for batch in slices(batches, "text"):
            texts = [x.decode() for x in unzipped(batch["text"].to_pylist())]
            sets, good = [], []
            for a, b, words in zip(batch["key_a"].to_pylist(), batch["key_b"].to_pylist(), word_hashes(texts), strict=True):
                own = np.unique(shingles(words))
                good.append(len(own) > 0 and set_key(own) == (a, b))
                sets.append(own.tobytes())
            out = batch.drop_columns(["text"]).append_column("sets", pa.array(sets, pa.binary()))
            yield out.filter(pa.array(good, pa.bool_()))

    shape = asked.drop("text").schema
    sets = asked.select("text", *shape.names).mapInArrow(with_sets, shape.add("sets", "binary")).dropDuplicates(["rep", *keys])
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "key_a", "block", "copies", "sets")
    dealt = dealt.repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
    ratio = Fraction(str(similarity))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(key, rows):
            out = [*_linked(rows, ratio, key[1] != key[2])] if len(rows) > 1 else []
            flat = [(*node, n, *to) for node, n, to in out]
            return pa.record_batch({k: pa.array(x, pa.int64()) for k, x in zip(("rep", "set", "links", "to", "to_set"), zip(*flat, strict=True), strict=True)}) if out else None

        now, rows = None, []
        for batch in batches:
            for grp, lo, hi, rep, key, block, copies, data in zip(*(batch[c].to_pylist() for c in ("grp", "lo", "hi", "rep", "key_a", "block", "copies", "sets")), strict=True):
                if (grp, lo, hi) != now:
                    if rows and (got := told(now, rows)):
                        yield got
                    now, rows = (grp, lo, hi), []
                rows.append(((rep, key), block, copies, np.frombuffer(data, np.uint64)))
        if rows and (got := told(now, rows)):
            yield got
        rows.clear()
        give_back()

    found = keep(dealt.mapInArrow(verify, "rep long, set long, links long, to long, to_set long"), "links")
    edges = found.select(F.struct("rep", "set").alias("a"), F.struct(F.col("to").alias("rep"), F.col("to_set").alias("set")).alias("b"), "links")
    classes = components(edges.select("a", "b").where("a <> b"))
    linked = edges.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    answer = reps.join(linked, "node", "left").join(classes, "node", "left")
    answer = answer.select(*keys, "rep", F.coalesce("label.rep", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # copies look their partition's row up first, so that no text with very many copies is joined in one task
    near = worded.select("run", *keys).distinct().join(answer, keys)
    named = worded.select("doc_id", "mark", "run", *keys).join(near, ["run", *keys]).select("doc_id", "mark", "label", "n_links", "rep")
    alone = signed.where("size = 0").select("doc_id", "mark", F.col("doc_id").alias("label"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("rep"))
    given = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return named.unionByName(alone).select(given("doc_id").alias("doc_id"), "mark", given("label").alias("class_id"), F.col("n_links").cast("long").alias("n_links"), given("rep").alias("class_rep"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its columns; of each class of linked rows those with the smallest doc_id stay."""
    return without(docs, jaccard_links(docs, similarity).where("not (doc_id <=> class_id)"))
