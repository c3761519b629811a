"""Repeated passages: bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Content-chosen anchors deal the work out: of the 24-byte strings in any 50-byte window the one with the smallest hash is the
window's anchor, so equal windows have equal anchors wherever they stand. Only windows whose anchor occurs in several
documents can repeat; they are brought together by anchor, and the suffixes of the distinct ones are sorted by the
difference-cover method (sampled triples, recursion on their names, merge of the rest); neighbours that agree in
their first 50 bytes are equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import keep, row_mark, slices, small, unzipped, without, zipped
from .exact_dedup import exact_groups
from .shared_keys import cut_keys, key_bytes, parts_for, shared_keys, unpack_keys

WINDOW, GRAM = 50, 24
_NO_ID = -(2**63)
_BATCH_BYTES = 2_000_000


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings of ``data``: those of 8 bytes by doubling, then joined."""
    from .shingles import mixed

    h = mixed(np.arange(1, 257, dtype=np.uint64))[data]
    step = 1
    while step < 8:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    n = len(data) - GRAM + 1
    total = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mixed(total)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def window_anchors(data: np.ndarray) -> np.ndarray:
    """The anchor (hash) of each window of ``data``, at least WINDOW bytes."""
    return _sliding_min(_gram_hashes(data), WINDOW - GRAM + 1)


def anchor_keys(texts: list[str]) -> list[np.ndarray]:
    """The distinct anchors of each text's windows."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at < len(texts) and (not part or held < _BATCH_BYTES):
            part.append(texts[at].encode())
            held += len(part[-1])
            at += 1
        sizes = np.array([*map(len, part)], np.int64)
        data = np.frombuffer(b"".join(part), np.uint8)
        if len(data) < WINDOW:
            out += [np.zeros(0, np.uint64)] * len(part)
            continue
        anchors = window_anchors(data)
        new = np.flatnonzero(np.diff(anchors, prepend=anchors[0] ^ np.uint64(1)) != 0)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), (ends - WINDOW + 1).tolist(), strict=True):
            if b <= a:
                out.append(np.zeros(0, np.uint64))
                continue
            i, j = np.searchsorted(new, [a, b])
            out.append(np.append(anchors[new[i:j]], anchors[a]))
    return out


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Names from 1 in the order of the rows of ``columns`` (non-negative integers)."""
    name = columns[0]
    for more in columns[1:]:
        base = np.int64(more.max()) + 1
        if int(name.max()) >= (2**62) // int(base):
            name = np.unique(name, return_inverse=True)[1]
        name = name * base + more
    return np.unique(name, return_inverse=True)[1] + 1


def suffix_ranks(text: np.ndarray, need: int, covered: int = 1) -> np.ndarray:
    """Ranks of the suffixes of ``text`` (positive integers) by their first ``need`` characters at least.

    The difference-cover method: suffixes at 1 and 2 modulo 3 are named by their triples; if names repeat, the ranks of the
    string of names are found in the same way; the suffixes at 0 modulo 3 follow from their first character and the rank
    after it, and are merged in. ``covered``: characters of the first text that one of ``text`` stands for; when a
    triple stands for ``need``, equal names are ties and the recursion ends.
    """
    n = len(text)
    if n < 3 or covered >= need:
        order = np.unique(text, return_inverse=True)[1]
        if covered >= need:
            return order + 1
        tails = [tuple(text[i:].tolist()) for i in range(n)]
        by = {t: k for k, t in enumerate(sorted(set(tails)), 1)}
        return np.array([by[t] for t in tails], np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a last triple of padding ends the first half
    sample = np.concatenate([one, two])
    names = _dense(s[sample], s[sample + 1], s[sample + 2])
    if names.max() < len(names) and covered * 3 < need:
        names = suffix_ranks(names, need, covered * 3)
    ranks = np.zeros(n + 4, np.int64)
    ranks[sample] = names
    zero, one = np.arange(0, n, 3), one[one < n]
    out = np.zeros(n, np.int64)
    # keys that compare a suffix at 0 with one at 1, and with one at 2
    with_one = _dense(np.concatenate([s[zero], s[one]]), np.concatenate([ranks[zero + 1], ranks[one + 1]]))
    with_two = _dense(*(np.concatenate([a[zero + k], a[two + k]]) for k, a in ((0, s), (1, s), (2, ranks))))
    z1, k1, z2, k2 = with_one[: len(zero)], with_one[len(zero) :], with_two[: len(zero)], with_two[len(zero) :]

    def below(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How many of ``of`` are smaller than each key: both are dense names, so they are counted."""
        n = np.bincount(of, minlength=int(keys.max(initial=0)) + 1)
        return (np.cumsum(n) - n)[keys]

    out[zero] = below(z1, z1) + below(z1, k1) + below(z2, k2)
    rest = np.concatenate([one, two])
    among = below(ranks[rest], ranks[rest])
    out[one] = among[: len(one)] + below(k1, z1)
    out[two] = among[len(one) :] + below(k2, z2)
    return out + 1


def repeated_windows(contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its windows also stand in a context with a smaller number in ``docs``."""
    sizes = np.array([*map(len, contexts)], np.int64)
    text = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    chars = text.astype(np.int64) + 2
    chars[begin + sizes] = 1
    ranks = suffix_ranks(chars, WINDOW)
    starts = np.concatenate([b + np.arange(n - WINDOW + 1) for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)])
    owner = np.repeat(docs, sizes - WINDOW + 1)
    order = np.argsort(ranks[starts], kind="stable")
    view = np.lib.stride_tricks.sliding_window_view(text, WINDOW)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 200_000):
        to = min(len(order), at + 200_000)
        new[at:to] = (view[starts[order[at:to]]] != view[starts[order[at - 1 : to - 1]]]).any(axis=1)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(owner[order], first)
    repeated = np.zeros(len(order), bool)
    repeated[order] = owner[order] > np.repeat(least, np.diff(first, append=len(order)))
    return np.split(repeated, np.cumsum(sizes - WINDOW + 1)[:-1])


_OUT = pa.schema([("part", pa.int32()), ("anchor", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("context", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _OUT, strict=True)] if rows else [pa.nulls(0, f.type) for f in _OUT], schema=_OUT)


def _contexts(parts: int):
    """Windows in a row with one shared anchor, as rows with a context; stretches found to repeat at once, as rows without."""

    width = key_bytes(parts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
            done: list[tuple] = []
            doc_ids, marks, lists = (batch[c].to_pylist() for c in ("doc_id", "mark", "keys"))
            for doc, mark, raw, keys in zip(doc_ids, marks, unzipped(batch["text"].to_pylist()), lists, strict=True):
                data = np.frombuffer(raw, np.uint8)
                if len(data) < WINDOW:
                    continue
                anchors = window_anchors(data)
                first = np.flatnonzero(np.diff(anchors, prepend=anchors[0] ^ np.uint64(1)) != 0)
                last = np.append(first[1:], len(anchors)) - 1
                shared = np.isin(cut_keys(anchors[first], width), unpack_keys(keys, width))
                for anchor, a, b in zip(anchors[first[shared]].tolist(), first[shared].tolist(), (last[shared] + WINDOW).tolist(), strict=True):
                    spots = seen.setdefault((anchor, raw[a:b]), [])
                    if spots and spots[0][0] < doc:
                        done.append((doc % parts, None, doc, mark, a, b, None))
                        continue
                    if spots and spots[0][0] > doc:
                        done += [(d % parts, None, d, m, s, s + b - a, None) for d, m, s in spots]
                        spots.clear()
                    spots.append((doc, mark, a))
            rows = [(anchor % parts, anchor - 2**63, d, m, s, s + len(context), context) for (anchor, context), spots in seen.items() for d, m, s in spots]
            for all_rows in (rows, done):
                for at in range(0, len(all_rows), 50_000):
                    yield _rows(all_rows[at : at + 50_000])

    return find


def _repeats(table: pa.Table) -> pa.Table:
    """The repeated stretches (doc_id, mark, start, end) of a part's contexts."""
    told = table.filter(pc.is_null(table["context"])).select(["doc_id", "mark", "start", "end"])
    table = table.filter(pc.is_valid(table["context"]))
    if not table.num_rows:
        return told
    codes = table["context"].combine_chunks().dictionary_encode()
    code, anchor, doc, mark, start, end = codes.indices.to_numpy(), *(table[c].to_numpy() for c in ("anchor", "doc_id", "mark", "start", "end"))
    order = np.lexsort((doc, code, anchor))
    code, anchor, doc, mark, start, end = (x[order] for x in (code, anchor, doc, mark, start, end))
    new = np.append(True, (code[1:] != code[:-1]) | (anchor[1:] != anchor[:-1]))
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = doc[first]
    whole = doc > least[group]
    out = [(d, m, s, e) for d, m, s, e in zip(doc[whole].tolist(), mark[whole].tolist(), start[whole].tolist(), end[whole].tolist(), strict=True)]
    # anchors with several contexts: compare the windows of one of each
    kinds = np.cumsum(np.append(True, anchor[first][1:] != anchor[first][:-1])) - 1
    several = np.flatnonzero(np.bincount(kinds)[kinds] > 1)
    if len(several):
        found = repeated_windows([codes.dictionary[int(c)].as_py() for c in code[first[several]]], least[several])
        begin, stop = first, np.append(first[1:], len(doc))
        for g, hit in zip(several.tolist(), found, strict=True):
            if not hit.any():
                continue
            padded = np.zeros(len(hit) + 2, bool)
            padded[1:-1] = hit
            edge = np.flatnonzero(padded[1:] != padded[:-1])
            for i in range(begin[g], stop[g]):
                if whole[i]:
                    break
                out += [(int(doc[i]), int(mark[i]), int(start[i]) + a, int(start[i]) + b - 1 + WINDOW) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    names = ("doc_id", "mark", "start", "end")
    found = pa.table({k: pa.array(x, pa.int64()) for k, x in zip(names, zip(*out, strict=True) if out else [[]] * 4, strict=True)})
    return pa.concat_tables([found, told.cast(found.schema)])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, start, end): stretches of bytes to remove; they may overlap. ``docs``: doc_id, mark, text, none null."""
    parts = parts_for(docs)
    long = docs.where(F.octet_length("text") >= WINDOW)
    shared = shared_keys(long, anchor_keys, parts)
    asked = zipped(long).join(shared, "doc_id").select("doc_id", "mark", "text", "keys")
    schema = "part int, anchor long, doc_id long, mark long, start long, end long, context binary"
    return asked.mapInArrow(_contexts(parts), schema).groupBy("part").applyInArrow(_repeats, "doc_id long, mark long, start long, end long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Texts are UTF-8 bytes, null counts as empty. A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller doc_id, judged on the input. Rows with the same doc_id never remove from each other, and each is judged by its own
    text; a null doc_id is smaller than any other (it is -2**63 inside, so no doc_id may be that). Texts under 50 bytes stay whole. An empty table gives no rows; further columns are
    ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("doc_id"), text.alias("text"))
    groups = exact_groups(own, F.col("text"))
    copies = keep(groups.where("not kept"), "copies")
    # a whole copy goes as a whole, if it has 50 bytes; its windows are those of the document it copies
    own = without(own, copies.where(F.col("n_bytes") >= WINDOW)).withColumn("mark", row_mark(F.col("text")))
    whole = copies.where(F.col("n_bytes") >= WINDOW)
    given = F.nullif(F.col("doc_id"), F.lit(_NO_ID)).alias("doc_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = whole.select(given, "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), none.alias("kept_sha256"), F.lit(b"").alias("kept"))
    spans = keep(repeated_spans(own).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    ids = keep(spans.select("doc_id").distinct(), "ids")
    n = ids.count()
    touched = zipped(own.join(small(ids, n, 8), "doc_id", "left_semi"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    zero = F.lit(0).cast("long")
    rest = own.join(small(ids, n, 8), "doc_id", "left_anti").select(given, size, zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "UTF-8").alias("kept"))
    joined = touched.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            doc_ids, starts_in, ends_in = (batch[c].to_pylist() for c in ("doc_id", "starts", "ends"))
            for doc, raw, starts, ends in zip(doc_ids, unzipped(batch["text"].to_pylist()), starts_in, ends_in, strict=True):
                removed = spans = 0
                left = raw
                if starts:
                    change = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(change, starts, 1)
                    np.add.at(change, ends, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((None if doc == _NO_ID else doc, len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
            if rows:
                names, kinds = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), (*[pa.int64()] * 4, pa.string(), pa.binary())
                yield pa.record_batch({k: pa.array(x, t) for k, x, t in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    cut_texts = joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut_texts.unionByName(rest).unionByName(whole)
