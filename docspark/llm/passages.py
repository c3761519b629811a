"""Near-duplicate passages: compact windows of min-hashes, joined by bands of hash functions, then verified.

For a hash function, a compact window (l, c, r) says that shingle c has the smallest hash of shingles l..r: every stretch
within l..r that contains c has the min-hash of c. The windows are the nodes of the Cartesian tree over the hashes
that are at least as wide as the shortest passage, so their number follows the length of the text divided by that width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_BYTES, components, keep, row_mark, slices, small, unzipped, without, zipped
from .decontaminate import n_words
from .exact_dedup import exact_groups
from .shared_keys import cut_keys, key_bytes, parts_for, shared_keys, unpack_keys
from .shingles import WORDS, mixed, shingles, word_hashes

#: Words of the shortest passage, similarity of shingle sets, bands of two hash functions each: 1 - (1 - 0.8**2)**7 = 0.9992.
PASSAGE_WORDS, SIMILARITY, BANDS = 50, 0.8, 7
#: Documents of a key's block: two blocks are compared by one task.
BLOCK_DOCS = 4096
#: Pairs for each document of a block that go on to be compared once for all keys; a block compares further ones itself, so that few rows leave it.
PAIRS_SENT = 64
#: How often rows that are left choose a leader among themselves before they are compared with all others.
ROUNDS = 3
WIDTH = PASSAGE_WORDS - WORDS + 1
_NO_ID = -(2**63)
_BATCH_SHINGLES = 200_000
#: Pairs of equal shingles that are held at once.
_MOST_PAIRS = 500_000
_TIE = np.uint64(0xFFFF)
#: Texts whose shingles stand in them more often than this on average are matched as sets of shingles only.
_REPEATS = 4
#: Shingles of a run that two passages of at least 0.8 have in common somewhere, with a margin: w shingles bear at most w / 45 edits of a word,
#: each of which takes 5, so the longest run between edits has 20 or more.
RUN = 16
#: Stretches whose ranges are tried against each other at once.
RECTANGLES = 36
#: Cells of a table of ranges and shingles that is held at once, and rows of a key that are compared by one product.
_MOST_CELLS, _MOST_ROWS = 2_000_000, 512


def compact_windows(values: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the compact windows of ``width`` values at least; a 0 ends all windows. Of equal values the first counts as smaller:
    the tree over many equal ones is a path, so callers make values distinct (see ``_hashes``).

    The centre of a wide window is the smallest of half of it, to its left or to its right; so is the next smaller value on either
    side of such a centre. Only these few are looked at.
    """
    half = (width + 1) // 2
    low = _sliding(values, half)
    near = np.zeros(len(values), bool)
    if len(low):
        near[: len(low)] |= low == values[: len(low)]
        near[half - 1 :] |= low == values[half - 1 :]
    spots = np.flatnonzero(near)
    own = values[spots]
    edges = []
    for back in (False, True):
        # a value that isn't smaller passes on what it knows itself, so steps grow longer
        v = own[::-1] if back else own
        smaller = np.arange(-1, len(own) - 1)
        open_ = np.flatnonzero(smaller >= 0)
        while len(open_):
            seen = smaller[open_]
            open_ = open_[(seen >= 0) & ((v[seen] >= v[open_]) if back else (v[seen] > v[open_]))]
            smaller[open_] = smaller[smaller[open_]]
        edges.append(len(own) - 1 - smaller[::-1] if back else smaller)
    left = np.where(edges[0] >= 0, spots[edges[0]] + 1, 0) if len(own) else spots
    right = np.append(spots, len(values))[edges[1]] - 1 if len(own) else spots
    wide = (right - left + 1 >= width) & (own > 0)
    return left[wide], spots[wide], right[wide]


def _sliding(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return h[:0]
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[: len(h) - (width - step)], h[width - step :]) if width > step else h


def _hashes(sequence: np.ndarray, k: int, ties: np.ndarray) -> np.ndarray:
    """Hash function ``k`` of the shingles, 0 between texts. The lowest bits (``ties``) depend on the place: repeats of a shingle are ordered by
    chance, so the tree over them is as flat as over other shingles."""
    values = mixed(sequence ^ np.uint64(0xA24BAED4963EE407 + 7919 * k))
    values = (values & ~_TIE) | ties
    values[sequence == 0] = 0
    return values


def _band_windows(sequence: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, l, r, c): stretches of ``sequence`` (shingles, 0 between texts) over which both min-hashes of a band are known; c: where the first stands.

    If some places are ``wanted``, only those that have one of them.
    """
    before = None if wanted is None else np.append(0, np.cumsum(wanted))
    keys, lows, highs, spots = [], [], [], []
    ties = (mixed(np.arange(len(sequence), dtype=np.uint64)) & _TIE) | np.uint64(1)
    for band in range(BANDS):
        sides = []
        for k in (2 * band, 2 * band + 1):
            low, spot, high = compact_windows(_hashes(sequence, k, ties))
            good = slice(None) if before is None else before[high + 1] > before[low]
            sides.append((low[good], spot[good], high[good]))
        (l1, c1, r1), (l2, c2, r2) = sides
        first, last = np.searchsorted(c2, l1), np.searchsorted(c2, r1, "right")
        n = last - first
        a = np.repeat(np.arange(len(c1)), n)
        b = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        low, high = np.maximum(l1[a], l2[b]), np.minimum(r1[a], r2[b])
        good = (high - low + 1 >= WIDTH) & (np.minimum(c1[a], c2[b]) >= low) & (np.maximum(c1[a], c2[b]) <= high)
        if before is not None:
            good[good] = before[high[good] + 1] > before[low[good]]
        a, b = a[good], b[good]
        keys.append(mixed(sequence[c1[a]] * np.uint64(0x9E3779B97F4A7C15) + sequence[c2[b]] + np.uint64(band)))
        lows.append(low[good])
        highs.append(high[good])
        spots.append(c1[a])
    return np.concatenate(keys), np.concatenate(lows), np.concatenate(highs), np.concatenate(spots)


def passage_windows(texts: list[str], wanted: Callable[[int, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text (shingles, keys, l, r, c); of windows without one of the places ``wanted`` of a text (its number, its shingles), if given, none."""
    own = [np.maximum(shingles(w), np.uint64(1)) for w in word_hashes(texts)]
    at = 0
    while at < len(own):
        part, held = [], 0
        while at < len(own) and (not part or held < _BATCH_SHINGLES):
            part.append(own[at])
            held += len(own[at]) + 1
            at += 1
        zero = np.zeros(1, np.uint64)
        marks = None if wanted is None else np.concatenate([x for i, s in enumerate(part, at - len(part)) for x in (wanted(i, s), zero > zero)])
        keys, low, high, spot = _band_windows(np.concatenate([x for s in part for x in (s, zero)]), marks)
        order = np.argsort(low, kind="stable")
        keys, low, high, spot = keys[order], low[order], high[order], spot[order]
        sizes = np.array([len(s) + 1 for s in part])
        begin = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(low, np.append(begin, begin[-1] + sizes[-1]))
        for s, base, a, b in zip(part, begin.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield s, keys[a:b], low[a:b] - base, high[a:b] - base, spot[a:b] - base


def window_keys(texts: list[str]) -> list[np.ndarray]:
    return [k for _, k, *_ in passage_windows(texts)]


def anchored_keys(texts: list[str], anchors: list[list[bytes]], width: int) -> list[np.ndarray]:
    """``window_keys`` of the windows that have one of the document's shared ``anchors`` (see ``run_anchors``; packed to ``width`` bytes) in
    them: one that has none has no run in common with another document, so no passage."""
    shared = lambda i, own: np.isin(cut_keys(mixed(own), width), unpack_keys(anchors[i], width))
    return [keys for _, keys, *_ in passage_windows(texts, shared)]


def _alike(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, start in b, end in b) of all maximal stretches that run alike in both, by diagonals over all occurrences."""
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    first, last = np.searchsorted(ordered, a), np.searchsorted(ordered, a, "right")
    n = last - first
    total = np.cumsum(n)
    starts, ends = [], []
    at = 0
    while at < len(a):  # only the ends of stretches are held, not all pairs of occurrences
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _MOST_PAIRS, "right")))
        count = n[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = order[np.arange(len(i)) + np.repeat(first[at:to] - (np.cumsum(count) - count), count)]
        before = (i > 0) & (j > 0)
        before[before] = a[i[before] - 1] == b[j[before] - 1]
        after = (i < len(a) - 1) & (j < len(b) - 1)
        after[after] = a[i[after] + 1] == b[j[after] + 1]
        starts.append(np.stack([j[~before] - i[~before], i[~before]]))
        ends.append(np.stack([j[~after] - i[~after], i[~after]]))
        at = to
    (d, s), (_, e) = (x[:, np.lexsort((x[1], x[0]))] for x in (np.concatenate(starts, axis=1), np.concatenate(ends, axis=1)))
    order = np.lexsort((d, s))
    s, e, d = s[order], e[order] + 1, d[order]
    return list(zip(s.tolist(), e.tolist(), (s + d).tolist(), (e + d).tolist(), strict=True))


def _without_repeats(a: np.ndarray, b: np.ndarray, stretches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Stretches that add something: where texts repeat themselves, those that lie in wider ones on both sides are left out.

    Of equally wide ones those on the diagonal with the most alike come first, so that what belongs together stays together.
    """
    if len(stretches) < 2:
        return stretches
    s, e, t, u = np.array(stretches, np.int64).T
    diagonal, at = np.unique(t - s, return_inverse=True)
    main = diagonal[np.bincount(at, e - s).argmax()]
    left, right, taken = np.zeros(len(a), bool), np.zeros(len(b), bool), []
    for i in np.lexsort((s, np.abs(t - s - main), s - e)).tolist():
        one, two = left[s[i] : e[i]], right[t[i] : u[i]]
        if not (one.all() and two.all()):
            one[:] = two[:] = True
            taken.append(i)
    return [stretches[i] for i in sorted(taken)]


def _repetitive(a: np.ndarray, b: np.ndarray, similarity: float) -> list[tuple[int, int, int, int]]:
    """Passages of texts that repeat themselves over and over: pairs of the stretches that consist of common shingles, as sets."""
    runs = []
    for own, other in ((a, b), (b, a)):
        common = np.concatenate([[False], np.isin(own, other), [False]])
        edge = np.flatnonzero(common[1:] != common[:-1])
        runs.append([(s, e, np.unique(own[s:e])) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - s >= WIDTH])
    out = []
    for s, e, x in runs[0]:
        for t, u, y in runs[1]:
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                out.append((s, e, t, u))
    return out


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``a`` and ``b`` with small numbers in place of shingles, and how many there are: everything after it needs no sorting."""
    joint = np.concatenate([a, b])
    order = np.argsort(joint)
    ordered = joint[order]
    code = np.empty(len(joint), np.int64)
    code[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])[: len(joint)])
    return code[: len(a)], code[len(a) :], int(code.max(initial=-1)) + 1


def _common(a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running counts (from 0) over ``a``: of shingles that are ``in_b`` too, and of those that stood in ``a`` before."""
    first, places = np.empty(len(in_b), np.int64), np.arange(len(a))
    first[a[::-1]] = places[::-1]
    common, again = np.zeros(len(a) + 1, np.int64), np.zeros(len(a) + 1, np.int64)
    np.cumsum(in_b[a], out=common[1:])
    np.cumsum(first[a] != places, out=again[1:])
    return common, again


def _enough(distinct: np.ndarray | int, other: int, similarity: float) -> np.ndarray:
    """Shingles that passages with ``distinct`` different ones, and ``other`` at least, have in common if they are similar enough."""
    return np.maximum(similarity * distinct, similarity / (1 + similarity) * (distinct + other)) - 1e-6


def _dense(common: np.ndarray, again: np.ndarray, similarity: float, other: int) -> bool:
    """Whether any stretch of WIDTH or more has enough in common for a passage: see ``_enough``, which asks more of short stretches."""
    excess = common - similarity * (np.arange(len(common)) - again)
    # from here on its first term is the larger one, if nothing repeats
    wide = math.ceil(WIDTH / similarity)
    for width in (WIDTH, wide):
        if len(common) <= width or (excess[width:] - np.minimum.accumulate(excess[:-width])).max() < -1e-6:
            break
    else:
        return True
    for n in range(WIDTH, min(wide, len(common))) if width == wide else ():
        if (common[n:] - common[:-n] >= _enough(n - (again[n:] - again[:-n]), other, similarity)).any():
            return True
    return False


def _fewest(a: np.ndarray, counted: np.ndarray | None = None) -> int:
    """The fewest distinct shingles of any WIDTH places of ``a`` (as wide at least), those at ``counted`` places if given."""
    order = np.argsort(a, kind="stable")
    same = a[order[1:]] == a[order[:-1]]
    before = np.full(len(a), -1)
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(len(a)) if counted is None else np.flatnonzero(counted)
    # a place counts for the starts from which it is the first one of its shingle
    first = np.maximum(np.maximum(before[at] + 1, at - WIDTH + 1), 0)
    steps = np.bincount(first, minlength=len(a) + 1) - np.bincount(at + 1, minlength=len(a) + 1)
    return int(np.cumsum(steps[: len(a) - WIDTH + 1]).min())


def _alone(a: np.ndarray, b: np.ndarray, common: np.ndarray, both: int, similarity: float) -> bool:
    """Whether so many shingles that aren't ``common`` stand in any WIDTH places of ``a`` and ``b`` that no passages can be similar enough,
    even with all ``both`` common ones: what passages don't have in common is at most 1 / similarity - 1 of what they have."""
    most = both * (1 / similarity - 1) + 1e-6
    few = _fewest(a, ~common[a])
    return few > most or few + _fewest(b, ~common[b]) > most


def _in_order(a: np.ndarray, b: np.ndarray, common: np.ndarray, repeats: int, similarity: float) -> bool:
    """Whether the ``common`` shingles, which stand once in ``a`` and once in ``b``, come in the same order in both, and no ranges from one stretch
    that runs alike to another one are similar enough. ``repeats``: places of both texts that repeat others.

    With a stretch that it has a part of, a range becomes no less similar, so that whole stretches bound all others.
    """
    where = np.empty(len(common), np.int64)
    where[b] = np.arange(len(b))
    i = np.flatnonzero(common[a])
    j = where[a[i]]
    cut = np.flatnonzero((np.diff(i) != 1) | (np.diff(j) != 1)) + 1
    first, last = np.append(0, cut), np.append(cut, len(i))
    if len(first) ** 2 > _MOST_CELLS or (j[1:] < j[:-1]).any():
        return False
    shared = last[None, :] - first[:, None]
    wide = sum(np.maximum(at[last - 1][None, :] + 1 - at[first][:, None], WIDTH) for at in (i, j))
    return not (shared >= similarity * (wide - repeats - shared) - 1e-6)[shared > 0].any()


class _Side:
    """What ``_rectangle`` asks of one of two texts: running counts, repeats (place, place before), places of ``many`` shingles."""

    def __init__(self, a: np.ndarray, counts: tuple[np.ndarray, np.ndarray], number: np.ndarray):
        self.size, (self.common, self.again) = len(a), counts
        order = np.argsort(a, kind="stable")
        same = a[order[1:]] == a[order[:-1]]
        at, before = order[1:][same], order[:-1][same]
        order = np.argsort(at)
        self.at, self.before = at[order], before[order]
        spot = np.flatnonzero(number[a] >= 0)
        self.places = np.sort(number[a[spot]] * (self.size + 1) + spot)
        self.many = int(number.max(initial=-1)) + 1
        self.least = max(WIDTH - len(self.at), 0)

    def distinct(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Distinct shingles of ranges: their width without the repeats whose place before lies inside too."""
        out = end - start
        if not len(self.at):
            return out
        starts, row = np.unique(start, return_inverse=True)
        last = np.searchsorted(self.at, end)
        step = max(1, _MOST_CELLS // len(self.at))
        for k in range(0, len(starts), step):
            inside = np.cumsum(self.before[None, :] >= starts[k : k + step, None], axis=1)
            mine = np.flatnonzero((row >= k) & (row < k + step) & (last > 0))
            out[mine] -= inside[row[mine] - k, last[mine] - 1]
        return out

    def holds(self, start: np.ndarray, end: np.ndarray, k: int, to: int) -> np.ndarray:
        """Whether ranges (rows) hold the shingles numbered ``k`` to ``to``, as numbers for a product of matrices."""
        starts, row = np.unique(start, return_inverse=True)
        base = np.arange(k, to) * (self.size + 1)
        spot = np.searchsorted(self.places, base[None, :] + starts[:, None])
        after = np.append(self.places, np.iinfo(np.int64).max)[spot] - base[None, :]
        return (after[row] < end[:, None]).astype(np.float32)


def _rectangles(a: np.ndarray, b: np.ndarray, stretches: list[tuple[int, int, int, int]], similarity: float, counts: tuple) -> list[tuple[int, int, int, int]]:
    """Passages among ``stretches`` that run alike, in any order: every pair of ranges that begin and end with a stretch is tried.

    A range that begins or ends otherwise is no more similar, unless it is too short for a passage; then it is widened. Stretches that a
    gap too wide for the similarity separates are tried apart, and RECTANGLES neighbours (in ``a``) at once.
    """
    out: list[tuple[int, int, int, int]] = []
    stretches = sorted(stretches)
    total = sum(e - s for s, e, _, _ in stretches)
    if total < similarity * WIDTH / 2 or min(len(a), len(b)) < WIDTH:
        return out
    known = _sides_of(a, b, counts)
    slack, groups, end = 1 / similarity - 1, [], -1
    for p in stretches:
        if not groups or p[0] - end > slack * total:
            groups.append([])
        groups[-1].append(p)
        end = max(end, p[1])
    for group in groups:
        for at in range(0, max(1, len(group) - RECTANGLES // 2), RECTANGLES // 2):
            todo = [p for p in group[at : at + RECTANGLES] if not any(s <= p[0] and p[1] <= e for s, e, _, _ in out)]
            while todo and (found := _rectangle(np.array(todo), similarity, known)):
                out.append(found)
                s, e, t, u = found
                rest = [p for p in todo if not (s <= p[0] and p[1] <= e and t <= p[2] and p[3] <= u)]
                # a range from within a stretch to within another one may hold neither as a whole
                if len(rest) == len(todo):
                    rest = [p for p in todo if p[1] <= s or e <= p[0] or p[3] <= t or u <= p[2]]
                todo = rest if len(rest) < len(todo) else []
    return out


def _sides_of(a: np.ndarray, b: np.ndarray, counts: tuple) -> tuple[_Side, _Side, tuple[np.ndarray, np.ndarray]]:
    """Both sides of ``_rectangle``, and the places in ``a`` and ``b`` of the shingles that stand once in either; ``counts``: ``_common`` of both."""
    codes = max(a.max(initial=-1), b.max(initial=-1)) + 1
    n, m = np.bincount(a, minlength=codes), np.bincount(b, minlength=codes)
    once, many = (n == 1) & (m == 1), (n > 0) & (m > 0) & (n + m > 2)
    number = np.where(many, np.cumsum(many) - 1, -1)
    where = np.empty(codes, np.int64)
    where[b] = np.arange(len(b))
    i = np.flatnonzero(once[a])
    return _Side(a, counts[0], number), _Side(b, counts[1], number), (i, where[a[i]])


def _ranges(low: np.ndarray, high: np.ndarray, side: _Side, other: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shingles in common, distinct shingles) of the ranges from a ``low`` to a ``high`` that have enough in common.

    Those under WIDTH are widened to the right, to the left and to both sides.
    """
    size = side.size
    low, high = np.unique(low), np.unique(high)
    first, last = np.repeat(low, len(high)), np.tile(high, len(low))
    wide = first < last
    first, last = first[wide], last[wide]
    more = np.maximum(WIDTH - (last - first), 0)
    start = np.maximum(np.minimum(np.concatenate([first, first - more, first - more // 2]), size - WIDTH), 0)
    end = np.maximum(np.tile(last, 3), start + WIDTH)
    start, end = np.divmod(np.unique(start * (size + 1) + end), size + 1)
    hits, least = side.common[end] - side.common[start], end - start - (side.again[end] - side.again[start])
    good = hits >= _enough(least, other, similarity)
    start, end, hits = start[good], end[good], hits[good]
    distinct = side.distinct(start, end)
    good = hits >= _enough(distinct, other, similarity)
    return start[good], end[good], hits[good], distinct[good]


def _rectangle(stretches: np.ndarray, similarity: float, known: tuple) -> tuple[int, int, int, int] | None:
    """The passage with the most in common of those that begin and end with one of ``stretches`` on either side; of equal ones the widest.

    ``known``: ``_sides_of`` both texts. What two ranges have in common of the shingles that stand once in either text is read from running counts
    over the ranges' edges; of the others a product of matrices counts those that both ranges hold. Both are exact.
    """
    one, two, points = known
    s, e, hits_a, all_a = _ranges(stretches[:, 0], stretches[:, 1], one, two.least, similarity)
    if not len(s):
        return None
    t, u, hits_b, all_b = _ranges(stretches[:, 2], stretches[:, 3], two, one.least, similarity)
    if not len(t):
        return None
    x, y = np.unique(np.concatenate([s, e])), np.unique(np.concatenate([t, u]))
    cell = np.searchsorted(x, points[0], "right") * (len(y) + 1) + np.searchsorted(y, points[1], "right")
    below = np.bincount(cell, minlength=(len(x) + 1) * (len(y) + 1)).reshape(len(x) + 1, -1).cumsum(0).cumsum(1)
    s_at, e_at, t_at, u_at = np.searchsorted(x, s), np.searchsorted(x, e), np.searchsorted(y, t), np.searchsorted(y, u)
    best, found = 0, None
    step = max(1, 200_000 // len(t))
    for at in range(0, len(s), step):
        own = slice(at, at + step)
        rows = below[e_at[own]] - below[s_at[own]]
        once = rows[:, u_at] - rows[:, t_at]
        both = np.minimum(once + one.many, np.minimum(hits_a[own, None], hits_b[None, :])) if one.many else once
        total = all_a[own, None] + all_b[None, :]
        good = (both >= similarity * (total - both) - 1e-9) & (both > 0) & (both >= best // (one.size + two.size + 1))
        if not good.any():
            continue
        if one.many:
            p, q = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
            exact = np.zeros((len(p), len(q)), np.float32)
            most = max(1, _MOST_CELLS // (len(p) + len(q)))
            for k in range(0, one.many, most):
                to = min(one.many, k + most)
                exact += one.holds(s[at + p], e[at + p], k, to) @ two.holds(t[q], u[q], k, to).T
            both = np.zeros_like(once)
            both[np.ix_(p, q)] = once[np.ix_(p, q)] + exact.astype(np.int64)
            good = good & (both >= similarity * (total - both) - 1e-9)
        # of equal ones the widest, of these the first
        rank = np.where(good, both * (one.size + two.size + 1) + (e - s)[own, None] + (u - t)[None, :], 0)
        i, j = divmod(int(np.argmax(rank)), len(t))
        if rank[i, j] > best:
            best, found = int(rank[i, j]), (int(s[at + i]), int(e[at + i]), int(t[j]), int(u[j]))
    return found


def matching_passages(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(start, end, start in b, end in b), ends exclusive: stretches of shingles whose sets are similar enough and wide enough.

    Stretches that run alike in both are joined with a later one while the similarity of the whole stays high enough,
    and each result is checked as sets; where that fails, the longest beginning that agrees and the wide stretches after it are results.
    What that leaves over, as where differences stand close together at the start or blocks changed places, is tried range by range.
    """
    if len(a) < len(b):  # along the longer one fewer beginnings are open at a time
        return sorted((s, e, t, u) for t, u, s, e in matching_passages(b, a, similarity))
    a, b, codes = _coded(a, b)
    n, m = np.bincount(a, minlength=codes), np.bincount(b, minlength=codes)
    in_a, in_b = n > 0, m > 0
    both, x, y = (int(np.count_nonzero(w)) for w in (in_a & in_b, in_a, in_b))
    # a passage has WIDTH places, and at most so many of them repeat others
    least_a, least_b = max(WIDTH - (len(a) - x), 0), max(WIDTH - (len(b) - y), 0)
    if not both or min(len(a), len(b)) < WIDTH or both < max(_enough(least_a, least_b, similarity), _enough(least_b, least_a, similarity)):
        return []
    if both >= similarity * (x + y - both) - 1e-9:
        return [(0, len(a), 0, len(b))]
    common, met = in_a & in_b, int(n @ m)
    if _alone(a, b, common, both, similarity) or met == both and _in_order(a, b, common, len(a) - x + len(b) - y, similarity):
        return []
    # of the shorter text first: fewer of its places can be left
    counts_b = _common(b, in_a)
    if not _dense(*counts_b, similarity, least_a):
        return []
    counts_a = _common(a, in_b)
    if not _dense(*counts_a, similarity, least_b):
        return []
    if (x + y) * _REPEATS < len(a) + len(b) and met > _REPEATS**2 * (len(a) + len(b)):
        return _repetitive(a, b, similarity)
    stretches = _without_repeats(a, b, _alike(a, b))
    slack = 1 / similarity - 1
    # from a start beyond it the gap is too wide for the similarity, however much follows
    reach = lambda end, shared: min((end + slack * (shared + len(a))) / (1 + slack), end + slack * len(b)) + WORDS
    done: list[list] = []  # start, end, start in b, end in b, shared, stretches, reach
    live: list[list] = []
    for s, e, t, u in stretches:
        if any(s > m[6] for m in live):
            done += [m for m in live if s > m[6]]
            live = [m for m in live if s <= m[6]]
        best = None
        for m in live:
            if t >= m[3] - WORDS and s >= m[1] - WORDS:
                both = m[4] + min(e - max(s, m[1]), u - max(t, m[3]))
                if both > m[4] and both >= similarity * ((e - m[0]) + (u - m[2]) - both) and (best is None or both > best[0]):
                    best = (both, m)
        if best:
            both, m = best
            m[:5] = [m[0], e, m[2], u, both]
            m[5].append((s, e, t, u))
            m[6] = reach(e, both)
        else:
            live.append([s, e, t, u, e - s, [(s, e, t, u)], reach(e, e - s)])

    def alike(s: int, e: int, t: int, u: int) -> bool:
        if min(e - s, u - t) < WIDTH:
            return False
        x, y = np.unique(a[s:e]), np.unique(b[t:u])
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    out = set()
    for s, _, t, _, _, parts, _ in done + live:
        # all of it if the sets agree, else the longest beginning and what is wide enough after that
        for k in range(len(parts), 1, -1):
            if alike(s, parts[k - 1][1], t, parts[k - 1][3]):
                out.add((s, parts[k - 1][1], t, parts[k - 1][3]))
                break
        else:
            k = 0
        out.update(p for p in parts[k:] if p[1] - p[0] >= WIDTH)  # each runs alike
    inside = lambda p: any(s <= p[0] and p[1] <= e and t <= p[2] and p[3] <= u for s, e, t, u in out)
    return sorted(out | set(_rectangles(a, b, [p for p in stretches if not inside(p)], similarity, (counts_a, counts_b))))


def _led_keys(windows: DataFrame) -> DataFrame:
    """Keys of ``windows`` (key, doc_id, low, high, ...) with several documents: key, n, the key's leader, which is its smallest document, and its
    largest one. Both are combined before the shuffle; numbers alone, so that nothing is sorted for it."""
    ends = [x for way, name in ((F.min, "lead"), (F.max, "last")) for x in (way("doc_id").alias(name), *((F.min_by if name == "lead" else F.max_by)(c, "doc_id").alias(f"{name}_{c}") for c in ("low", "high")))]
    return windows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1")


def _key_leaders(windows: DataFrame) -> DataFrame:
    """``windows`` (key, doc_id, low, high, at) of keys with several documents, with n and the key's leader. Adaptive execution may split a very common key."""
    return windows.join(_led_keys(windows).select("key", "n", "lead", "lead_low", "lead_high"), "key")


_MATCH = "doc_id long, lead long, start long, end long, lead_start long, lead_end long"


def _match_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "lead", "start", "end", "lead_start", "lead_end")
    if rows:
        yield pa.record_batch({k: pa.array(x, pa.int64()) for k, x in zip(names, zip(*rows, strict=True), strict=True)})


def _extents(met: DataFrame) -> DataFrame:
    """Each pair of documents (doc_id, lead) once, with the stretch of each that their common keys span."""
    return met.groupBy("doc_id", "lead").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("lead_low").alias("lead_low"), F.max("lead_high").alias("lead_high"))


def _plausible(rows: list[tuple[int, int, np.ndarray]], label: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of ``rows`` (doc_id, low, shingles) with as many shingles in common as a passage needs.

    ``label`` is changed by the caller: rows with equal labels have been found to belong together and aren't paired any more.

    Rows that share too few shingles with all others together go first, again until none goes: what a common line alone has
    brought here isn't paired.
    """
    sets = [np.unique(r[2]) for r in rows]
    fewest = np.array([WIDTH if len(r[2]) == len(x) else _fewest(r[2]) for r, x in zip(rows, sets, strict=True)])
    least = SIMILARITY * fewest
    left = np.arange(len(rows))
    while True:
        if len(left) < 2:
            return
        sizes = [len(sets[i]) for i in left]
        flat, owner = np.concatenate([sets[i] for i in left]), np.repeat(np.arange(len(left)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], column[shared]
        good = np.bincount(owner, minlength=len(left)) >= least[left]
        if good.all():
            break
        left = left[good]
    column = np.unique(column, return_inverse=True)[1]
    # how many shingles two rows have in common: for few rows and shingles by a product of matrices, else row by row
    if len(left) * (column[-1] + 1) <= _MOST_CELLS and len(left) <= _MOST_ROWS:
        holds = np.zeros((len(left), column[-1] + 1), np.float32)
        holds[owner, column] = 1
        enough = _enough(fewest[left][:, None], fewest[left][None, :], SIMILARITY)
        one, two = np.nonzero(np.triu((holds @ holds.T >= np.maximum(enough, enough.T)) & (label[left][:, None] != label[left][None, :]), 1))
        for i, j in zip(left[one].tolist(), left[two].tolist(), strict=True):
            if label[i] != label[j]:
                yield i, j
        return
    by_row = np.argsort(owner, kind="stable")
    ends = np.cumsum(np.bincount(owner, minlength=len(left)))
    by_column = column  # ascending
    first = np.searchsorted(by_column, np.arange(column[-1] + 2))
    for i in range(len(left)):
        now = label[left]
        if (now == now[i]).all():
            continue
        own = column[by_row[ends[i - 1] if i else 0 : ends[i]]]
        n = first[own + 1] - first[own]
        spot = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[spot], minlength=len(left))
        for j in np.flatnonzero(common >= np.maximum(_enough(fewest[left], fewest[left[i]], SIMILARITY), _enough(fewest[left[i]], fewest[left], SIMILARITY))).tolist():
            if j > i and label[left[j]] != label[left[i]]:
                yield int(left[i]), int(left[j])


def _class_matches(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Matches between documents of a key (``rows``: key, doc_id, low, high, class_id) in different classes, as ``_verified`` gives them.

    A key's rows are dealt to blocks of about BLOCK_DOCS; two blocks are met by one task. What it finds to be plausible, up to PAIRS_SENT for each of
    its rows, meets the same pair from other keys and is compared once; the rest is compared where it is found, which emits matches only.
    """
    sized = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("blocks"))
    placed = rows.join(sized, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.expr("substring(own, (low - base) * 4 + 1, (high - low + 1) * 4)")
    dealt = placed.join(own, "doc_id").select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id", "low", "class_id", part.alias("part"))
    # few bytes are much work here, so parts aren't joined by their bytes
    parts = 4 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compared(rows: list[tuple], cross: bool) -> tuple[list[tuple], list[tuple]]:
        out, sent, label = [], [], np.unique([r[4] for r in rows], return_inverse=True)[1]
        for i, j in _plausible([r[1:4] for r in rows], label):
            if cross and rows[i][0] == rows[j][0]:
                continue
            (_, d, low, a, _), (_, lead, lead_low, b, _) = sorted((rows[i], rows[j]), key=lambda r: -r[1])
            if len(sent) < PAIRS_SENT * len(rows):
                sent.append((d, lead, low, low + len(a) - 1, lead_low, lead_low + len(b) - 1))
            elif found := matching_passages(a, b):
                out += [(d, lead, low + s, low + e - 1 + WORDS, lead_low + t, lead_low + u - 1 + WORDS) for s, e, t, u in found]
                label[label == label[j]] = label[i]
        return out, sent

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for matched, rows in zip((True, False), compared(held, bool(now and now[1] != now[2])), strict=True):
                for batch in _match_rows(rows):
                    yield batch.append_column("matched", pa.array([matched] * len(batch), pa.bool_()))

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("key", "lo", "hi", "block", "doc_id", "low", "class_id", "part"))
            for key, lo, hi, block, doc, low, of, blob in zip(*columns, strict=True):
                if (key, lo, hi) != now:
                    yield from told()
                    now, held = (key, lo, hi), []
                held.append((block, doc, low, np.frombuffer(blob, "<u4"), of))
        yield from told()

    met = keep(dealt.mapInArrow(meet, _MATCH + ", matched boolean"), "met")
    once = met.where("not matched").select("doc_id", "lead", F.col("start").alias("low"), F.col("end").alias("high"), F.col("lead_start").alias("lead_low"), F.col("lead_end").alias("lead_high"))
    return met.where("matched").drop("matched").unionByName(_verified(_extents(once), own))


def run_anchors(texts: list[str]) -> list[np.ndarray]:
    """The smallest hash of each RUN shingles in a row: texts that have a run in common have an anchor in common."""
    out = []
    for words in word_hashes(texts):
        own = mixed(np.maximum(shingles(words), np.uint64(1)))
        out.append(np.unique(_sliding(own, RUN)))
    return out


_SPREAD = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("at", pa.list_(pa.int32())), ("own", pa.binary())])


def _spread(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each document a row for each key that it shares (key, low, high, at), and one with the shingles that these span (own)."""
    for batch in slices(batches, "text"):
        texts = [x.decode() for x in unzipped(batch["text"].to_pylist())]
        rows: list[tuple[np.ndarray, ...]] = []
        blobs: list[tuple[int, int, int, bytes]] = []
        for doc, (own, keys, low, high, at), known in zip(batch["doc_id"].to_pylist(), passage_windows(texts), batch["keys"].to_pylist(), strict=True):
            hit = np.isin(cut_keys(keys, width), unpack_keys(known, width))
            if not hit.any():
                continue
            keys, low, high, at = keys[hit], low[hit], high[hit], at[hit]
            order = np.argsort(keys, kind="stable")  # windows come in order of low
            keys, low, high, at = keys[order], low[order], high[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            start, end = int(low.min()), int(high.max())
            ends = np.append(first[1:], len(keys))
            rows.append((np.full(len(first), doc), keys[first].view(np.int64), low[first], np.maximum.reduceat(high, first), ends - first, at))
            blobs.append((doc, start, end, own[start : end + 1].astype("<u4").tobytes()))  # for verification four bytes tell shingles of two documents apart
        if rows:
            *made, sizes, at = (np.concatenate(x) for x in zip(*rows, strict=True))
            places = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(at, pa.int32()))
            yield pa.record_batch([*(pa.array(x, f.type) for x, f in zip(made, _SPREAD)), places, pa.nulls(len(sizes), pa.binary())], schema=_SPREAD)
            doc, start, end, own = zip(*blobs, strict=True)
            n = len(doc)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.nulls(n, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.nulls(n, pa.list_(pa.int32())), pa.array(own, pa.binary())], schema=_SPREAD)


def _verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (doc_id, lead, start, end, lead_start, lead_end), in words: the passages of ``pairs`` that are similar enough."""
    part = lambda low, high: F.expr(f"substring(own, ({low} - base) * 4 + 1, ({high} - {low} + 1) * 4)")
    one = pairs.join(own, "doc_id").select("doc_id", "lead", "low", "lead_low", "lead_high", part("low", "high").alias("mine"))
    two = one.join(own.withColumnRenamed("doc_id", "lead"), "lead").select("doc_id", "lead", "low", "lead_low", "mine", part("lead_low", "lead_high").alias("theirs"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, lead, low, lead_low, mine, theirs in zip(*(batch[c].to_pylist() for c in ("doc_id", "lead", "low", "lead_low", "mine", "theirs")), strict=True):
                for s, e, t, u in matching_passages(np.frombuffer(mine, "<u4"), np.frombuffer(theirs, "<u4")):
                    rows.append((doc, lead, low + s, low + e - 1 + WORDS, lead_low + t, lead_low + u - 1 + WORDS))
            yield from _match_rows(rows)

    return keep(two.mapInArrow(verify, _MATCH), "passages")


def _open_rows(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """The ``rows`` (key, doc_id, at, ...) whose shingle is covered by no confirmed passage of the document, wherever it stands there."""
    spans = _sides(matched).withColumnRenamed("doc_id", "own_id")
    covered = F.exists(rows["at"], lambda x: x.between(spans["start"], spans["end"] - WORDS))
    return rows.join(spans, (rows["doc_id"] == spans["own_id"]) & covered, "left_anti")


def _sides(matched: DataFrame) -> DataFrame:
    """Rows (doc_id, start, end) of both documents of each match."""
    return matched.select("doc_id", "start", "end").unionByName(matched.select(F.col("lead").alias("doc_id"), F.col("lead_start").alias("start"), F.col("lead_end").alias("end"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc_id, start, end) sorted by doc_id and start, joined where they overlap."""
    now = None
    for batch in batches:
        out = []
        for doc, start, end in zip(*(batch[c].to_pylist() for c in ("doc_id", "start", "end")), strict=True):
            if now and now[0] == doc and start <= now[2]:
                now[2] = max(now[2], end)
            else:
                if now:
                    out.append(now)
                now = [doc, start, end]
        if out:
            yield pa.record_batch({k: pa.array(x, pa.int64()) for k, x in zip(("doc_id", "start", "end"), zip(*out, strict=True), strict=True)})
    if now:
        yield pa.record_batch({k: pa.array([x], pa.int64()) for k, x in zip(("doc_id", "start", "end"), now, strict=True)})


def passage_matches(docs: DataFrame) -> DataFrame:
    """Verified matches (doc_id, lead, start, end, lead_start, lead_end) among ``docs`` (doc_id, text, unique) that link all that passages link.

    Compact windows give each document its keys. Every document of a key is compared with the key's leader, its smallest document. Rows that
    this doesn't explain (no confirmed passage of the document covers the key's shingle) get a leader among themselves, ROUNDS times.
    Then all documents of a key that are in different classes are compared, those with a confirmed passage too: what it matched may be
    unlike what another one is like, so that no link between classes is lost. Documents that belong together already need no pairs among
    themselves.
    """
    parts = parts_for(docs)
    width = key_bytes(parts)
    # only documents that have a run in common with another one can share a passage
    near = keep(shared_keys(docs, run_anchors, parts), "near")
    n, total = near.agg(F.count(F.lit(1)), F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda total, x: total + F.octet_length(x) + 16))).first()
    docs = docs.join(small(near.select("doc_id"), n, 8), "doc_id", "left_semi")
    row_bytes = (total or 0) // max(n, 1) + 16
    packed = n * row_bytes > BROADCAST_BYTES  # few anchors are broadcast; for many, texts are shuffled compressed
    asked = (zipped(docs) if packed else docs).join(small(near, n, row_bytes), "doc_id").select("doc_id", "text", "keys")

    def keys_of(texts: list, anchors: list[list[bytes]]) -> list[np.ndarray]:
        return anchored_keys([x.decode() for x in unzipped(texts)] if packed else texts, anchors, width)

    shared = shared_keys(asked, keys_of, parts, ("text", "keys"), "text" if packed else None)
    asked = zipped(docs).join(shared, "doc_id").select("doc_id", "text", "keys")
    found = keep(asked.mapInArrow(lambda b: _spread(b, width), "doc_id long, key long, low int, high int, at array<int>, own binary"), "windows")
    own = found.where("key is null").select("doc_id", F.col("low").alias("base"), "own")
    windows = found.where("key is not null").drop("own")
    led = keep(_led_keys(windows), "keys")
    # two documents are a pair; only the rows of more than two meet their leader
    many = led.where("n > 2").select("key", "lead", "lead_low", "lead_high")
    wide = keep(windows.join(small(many, many.count(), 32), "key"), "rows")
    two = led.where("n = 2").select(F.col("last").alias("doc_id"), "lead", F.col("last_low").alias("low"), F.col("last_high").alias("high"), "lead_low", "lead_high")
    others = wide.where("doc_id > lead")
    matched = _verified(_extents(two.unionByName(others.select(*two.columns))), own)
    left = keep(_open_rows(others.drop("lead", "lead_low", "lead_high"), matched), "open")
    for _ in range(ROUNDS):
        led = keep(_key_leaders(left).where("doc_id > lead"), "led")
        if led.isEmpty():
            break
        matched = matched.unionByName(_verified(_extents(led), own))
        left = keep(_open_rows(led.select("key", "doc_id", "low", "high", "at"), matched), "open")
    classes = components(matched.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct())
    members = wide.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    members = keep(members.select("key", "doc_id", "low", "high", F.coalesce("label", "doc_id").alias("class_id")), "members")
    mixed_keys = members.groupBy("key").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a < b").select("key")
    members = members.join(small(mixed_keys, mixed_keys.count(), 8), "key", "left_semi")
    return matched.unionByName(_class_matches(members, own))


def passage_links(docs: DataFrame) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_passages, passages.

    A passage has at least 50 words, and its set of five-word shingles a Jaccard similarity of 0.8 or more with that of a passage
    in another document. class_id is the smallest doc_id that links lead to, n_links the number of other documents in
    the class, copies one by one; passages lists start:end in words (end exclusive, joined where they
    overlap). A passage at similarity 0.8 shares a band with a probability of 1 - (1 - 0.8**2)**7 = 0.9992, an exact copy always.
    Null, empty and short texts stay alone; a long text is dealt with as a whole, however often it repeats its words. A null doc_id
    comes before others (it is -2**63 inside, so no doc_id may be that); rows that repeat a doc_id give one row, of the text that comes first
    in order of its hash. An empty table gives no rows; further columns are ignored, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    every = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).cast("long").alias("doc_id"), text.alias("text"))
    repeated = every.groupBy("doc_id").agg(F.min(row_mark(F.col("text"))).alias("mark"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "mark")
    repeated = keep(repeated, "repeated")
    # of rows that repeat a doc_id one is taken; where none does, nothing is shuffled
    if not repeated.isEmpty():
        others = every.join(repeated.withColumnRenamed("mark", "first"), "doc_id").where(row_mark(F.col("text")) != F.col("first"))
        every = without(every, others.select("doc_id", row_mark(F.col("text")).alias("mark"))).dropDuplicates(["doc_id"])
    groups = keep(exact_groups(every, F.col("text")), "groups")
    long = without(every, groups.where("not kept")).where(F.octet_length("text") >= 2 * PASSAGE_WORDS - 1)
    matched = keep(passage_matches(long), "matches")
    classes = components(matched.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct())
    spans = _sides(matched).repartition("doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(_joined, "doc_id long, start long, end long")
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # a whole copy has its original's class, and is one passage with it
    given = lambda c: F.nullif(c, F.lit(_NO_ID))
    sized = every.select("doc_id", n_words(F.col("text")).alias("n_words")).join(groups.select("doc_id", "keep_id", "group_size"), "doc_id")
    copied = (F.col("group_size") > 1) & (F.col("n_words") >= PASSAGE_WORDS)
    named = sized.join(classes.select(F.col("node").alias("keep_id"), "label"), "keep_id", "left")
    named = named.select("doc_id", "keep_id", "n_words", copied.alias("copied"), F.when(copied | F.col("label").isNotNull(), F.coalesce("label", "keep_id")).otherwise(F.col("doc_id")).alias("class_id"))
    members = named.groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("n_links"))
    # copies meet their original's few columns; adaptive execution splits the rows of a text or class with very many
    told = named.join(members, "class_id").join(listed.withColumnRenamed("doc_id", "keep_id"), "keep_id", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own_spans = F.when(F.col("copied"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", empty))
    return told.select(
        given(F.col("doc_id")).alias("doc_id"),
        given(F.col("class_id")).alias("class_id"),
        "n_links",
        F.size(own_spans).cast("long").alias("n_passages"),
        F.array_join(F.transform(own_spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("passages"),
    )
