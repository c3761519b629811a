"""Runs of words that repeat with a period, found in overlapping tiles per octave of periods and stitched from fragments.

A stretch has period q where each word equals the one q before. Octave by octave of q, boundaries are set so close that
any run of the octave has one inside. Documents are exploded into tiles around the boundaries; a tile is solved alone: Z-functions
forward and backward from a boundary say for all periods of the octave at once how far words go on to be the same.
What a tile finds is a fragment, cut off at its reach; fragments of a document and period that touch make one run.

A tile is only made around boundaries where half a run's least repetition can lie: there the words of a window
equal those one period later. Equal windows have equal hashes, so none is missed, and the Z-functions compare words.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, keep, slices

LEAST_WORDS, LEAST_POWER = 24, 3
#: Words of a tile, unless its octave needs more.
TILE_WORDS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A known repetition in a tenth of the documents, drawn by a checksum of the doc_id, to measure against."""
    if doc_id is None or not words or (h := zlib.crc32(b"%d" % doc_id)) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole = words[a : a + p] * -(-(n - a) // p)
    return words[:a] + whole[: n - a]


def octaves(most: int) -> Iterator[tuple[int, int, int, int]]:
    """(least period, end of the periods, boundary spacing and reach, window) of each octave with periods up to ``most``.

    The words that equal those q later are max(LEAST_WORDS - q, (LEAST_POWER - 1) q) at least, so never fewer than the spacing;
    on one side of a boundary among them there is a window of half of that.
    """
    low, end, spacing = 1, 8, 16
    while low <= most:
        yield low, end, spacing, spacing // 2
        low, end, spacing = end, 2 * end, 2 * end


def _flagged(ids: np.ndarray, most: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(least period, end, spacing, boundaries) of each octave where a window repeats one period of the octave later."""
    n = len(ids)
    hashes, width = (ids.astype(np.uint64) + np.uint64(1)) * _BASE, 1
    hashes ^= hashes >> np.uint64(29)
    power = int(_BASE)
    for low, end, spacing, window in octaves(most):
        while width < window:
            if len(hashes) <= width:
                return
            hashes = hashes[:-width] * np.uint64(power) + hashes[width:]
            power, width = power * power % (1 << 64), 2 * width
        marks = np.arange(0, n + 1, spacing)
        hit = np.zeros(len(marks), bool)
        # half a window before or behind the boundary; where it doesn't fit, no run reaches that far
        for at in (marks, marks - window):
            for block in range(0, len(marks), max(1, 2_000_000 // (end - low))):
                own = at[block : block + max(1, 2_000_000 // (end - low))]
                fits = (own >= 0) & (own + low < len(hashes))
                own = own[fits]
                if not len(own):
                    continue
                there = own[:, None] + np.arange(low, end)[None, :]
                same = (hashes[np.minimum(there, len(hashes) - 1)] == hashes[own][:, None]) & (there < len(hashes))
                hit[block + np.flatnonzero(fits)] |= same.any(axis=1)
        if hit.any():
            yield low, end, spacing, marks[hit]


def tiles(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """(document, least period, end, place of the tile, its boundaries, its words) for documents joined in ``ids``.

    ``starts``: where each begins, and the end. No word of one document equals one of another.
    """
    longest = int(np.diff(starts).max(initial=0))
    for low, end, spacing, marks in _flagged(ids, longest // LEAST_POWER):
        doc = np.searchsorted(starts, np.minimum(marks, len(ids) - 1), "right") - 1
        most = max(1, TILE_WORDS // spacing)
        i = 0
        while i < len(marks):
            j = i + 1
            while j < len(marks) and j - i < most and doc[j] == doc[i] and marks[j] == marks[j - 1] + spacing:
                j += 1
            a, b = int(starts[doc[i]]), int(starts[doc[i] + 1])
            lo, hi = max(a, int(marks[i]) - spacing), min(b, int(marks[j - 1]) + spacing + end)
            yield int(doc[i]), low, end, lo - a, marks[i:j] - lo, ids[lo:hi]
            i = j


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@cache
def _prime_factor(end: int) -> np.ndarray:
    """The least prime factor of each number under ``end``."""
    out = np.arange(end)
    for p in range(2, int(end**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, end, p)] = p
    return out


def fragments(words: np.ndarray, marks: list[int], low: int, end: int) -> list[tuple[int, int, int]]:
    """(period, from, to) in a tile: words from..to equal those one period later; ``to`` is exclusive.

    Only for periods whose block isn't itself a repetition, and only where it is long enough or goes on beyond the reach.
    """
    reach = max(16, end)
    found: dict[int, list[list[int]]] = {}
    own = words.tolist()
    for c in marks:
        ahead = own[c : c + reach + end]
        if len(ahead) <= low:
            continue
        z = np.array(z_function(ahead), np.int64)
        back = own[max(0, c - reach) : c][::-1]
        n = len(back)
        behind = own[max(0, c - reach) : c + end - 1][::-1]  # the last word before c + q stands end - 1 - q from its start
        q = np.arange(low, min(end, len(ahead)))
        fwd = np.minimum(z[q], reach)
        if n:
            zb = np.array(z_function([*back, -1, *behind]), np.int64)
            skip = len(behind) - n  # words at and after c that are there
            back_n = np.minimum(zb[n + 1 + skip - q], n)
        else:
            back_n = np.zeros(len(q), np.int64)
        least = np.maximum(LEAST_WORDS - q, (LEAST_POWER - 1) * q)
        good = (fwd + back_n >= least) | ((fwd == reach) | (back_n == reach)) & (fwd + back_n >= q)
        rest, block = q[good].copy(), q[good]
        primitive = np.ones(len(block), bool)
        factor = _prime_factor(end)
        while (more := rest > 1).any():
            p = np.where(more, factor[rest], 1)
            d = block // p
            primitive &= ~(more & (z[d] >= block - d))
            rest //= p
        for k, f, b in zip(block[primitive].tolist(), fwd[good][primitive].tolist(), back_n[good][primitive].tolist(), strict=True):
            spans = found.setdefault(k, [])
            if spans and c - b <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], c + f)
            else:
                spans.append([c - b, c + f])
    return [(k, a, b) for k, spans in found.items() for a, b in spans]


def _explode(rewrite: Rewrite | None):
    names = ("row", "doc_id", "n", "sha", "words", "low", "end", "at", "marks", "tile")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            rows, docs = batch["row"].to_pylist(), batch["doc_id"].to_pylist()
            every, ids, at = [], [], 0
            for doc, text in zip(docs, batch["text"].to_pylist(), strict=True):
                words = text.encode().split()  # splits at just the six ASCII characters of the word pattern
                words = rewrite(doc, words) if rewrite else words
                first: dict[bytes, int] = {}
                # a word is the place where it first stands
                ids.append(np.fromiter(map(first.setdefault, words, itertools.count(at)), np.int64, len(words)))
                every.append(words)
                at += len(words)
            starts = np.cumsum([0, *map(len, every)])
            got = list(tiles(np.concatenate(ids) if ids else np.zeros(0, np.int64), starts))
            out = []
            with_tiles = {d for d, *_ in got}
            for d, (row, doc, words) in enumerate(zip(rows, docs, every, strict=True)):
                joined = b" ".join(words)
                if d in with_tiles:
                    out.append((row, doc, len(words), None, tool.compress(joined), None, None, None, None, None))
                else:
                    out.append((row, doc, len(words), hashlib.sha256(joined).hexdigest(), None, None, None, None, None, None))
            for d, low, end, place, marks, words in got:
                own = (words - starts[d]).astype("<u4")
                out.append((rows[d], None, None, None, None, low, end, place, marks.astype("<i4").tobytes(), tool.compress(own.tobytes())))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

    return explode


_EXPLODED = "row long, doc_id long, n long, sha string, words binary, low int, end int, at long, marks binary, tile binary"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for batch in slices(batches, "tile"):
        out = []
        for row, low, end, at, marks, tile in zip(*(batch[c].to_pylist() for c in ("row", "low", "end", "at", "marks", "tile")), strict=True):
            words = np.frombuffer(tool.decompress(tile), "<u4")
            out += [(row, q, at + a, at + b) for q, a, b in fragments(words, np.frombuffer(marks, "<i4").tolist(), low, end)]
        if out:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["row", "period", "lo", "hi"])


def stitched(pieces: DataFrame) -> DataFrame:
    """Rows (row, period, start, length): the runs of fragments (row, period, lo, hi), which are joined where they touch."""
    each = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(each.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(0)))
    spans = marked.withColumn("span", F.sum("new").over(each.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "period", "span").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    length = F.col("hi") - F.col("start") + F.col("period")
    return spans.select("row", "period", "start", length.alias("length")).where((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_POWER * F.col("period")))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    tool = zstandard.ZstdDecompressor()
    for batch in slices(batches, "words"):
        out = []
        for doc, n, sha, packed, runs in zip(*(batch[c].to_pylist() for c in ("doc_id", "n", "sha", "words", "runs")), strict=True):
            told = sorted((r["start"], r["period"], r["length"]) for r in runs or [])
            listed = "".join(f"{s},{k},{p}\n" for s, p, k in told)
            best = max(told, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
            kept = None
            if packed is not None:
                joined = tool.decompress(packed)
                if told:
                    words = joined.split()
                    gone = np.zeros(n + 1, np.int64)
                    for s, p, k in told:
                        gone[s + p] += 1
                        gone[s + k] -= 1
                    joined = b" ".join(itertools.compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))
                sha, kept = hashlib.sha256(joined).hexdigest(), joined.decode() if told else None
            start, period, length = best or (None, None, None)
            out.append((doc, len(told), start, length, period, 1000 * length // period if best else None, hashlib.sha256(listed.encode()).hexdigest(), sha, [{"start": s, "length": k, "period": p} for s, p, k in told], kept))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its runs, the strongest of them, and its text without their repetitions.

    Columns: doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest length / period; equal ones: least start, then
    period), runs_sha256, collapsed_sha256, runs, collapsed (null where nothing is dropped). ``rewrite`` changes a document's words before.

    Null and empty texts have no words and no runs. A text of any length is cut into tiles of TILE_WORDS or four times its octave's
    period, which go to tasks of their own; the only parts that see a whole document are the first and the last, both linear in it. Rows that repeat a doc_id or have
    none are told apart by a row number. An empty table gives no rows; other columns aren't read, so their names can't clash.
    """
    texts = bounded(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = keep(texts.mapInArrow(_explode(rewrite), _EXPLODED), "run-tiles")
    tile = made.where("tile is not null").select("row", "low", "end", "at", "marks", "tile")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = stitched(tile.repartition(parts, F.xxhash64("row", "low", "at")).mapInArrow(_solve, "row long, period long, lo long, hi long"))
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    whole = made.where("n is not null").select("row", "doc_id", "n", "sha", "words")
    judged = whole.where("words is not null").join(listed, "row", "left")
    none = F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs")
    every = judged.select("doc_id", "n", "sha", "words", "runs").unionByName(whole.where("words is null").select("doc_id", "n", "sha", "words", none))
    shape = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return every.mapInArrow(_judge, shape)


def drop_repetitions(docs: DataFrame) -> DataFrame:
    """``docs`` (unique doc_ids) whose text lost the repetitions of its runs; texts without runs stay as they are, other columns too."""
    own = periodic_runs(docs).where("collapsed is not null").select(F.col("doc_id").alias("__doc"), F.col("collapsed").alias("__text"))
    joined = docs.join(own, docs["doc_id"] == own["__doc"], "left")
    return joined.select(*(F.coalesce("__text", docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns))
