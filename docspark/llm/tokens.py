"""Token ids of a byte-level BPE vocabulary, by the tokenizers library, a whole Arrow batch at a time.

The library spends most of its time on splitting texts and on bookkeeping per piece. Here numpy splits a batch of
texts into the pieces of the vocabulary's split pattern, and each distinct piece is encoded by the library once
per worker and remembered. Every remembered piece is compared with the text character by character, so a hash
collision can't change a result: such a text is encoded whole.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Characters of text handled at once, and what a worker remembers before it starts afresh (about 50 MB): both bound memory.
BATCH_CHARS = 1_000_000
MEMO_PIECES, MEMO_CHARS, MEMO_IDS = 700_000, 5_500_000, 2_400_000

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _classes() -> np.ndarray:
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        kinds[code] = _LETTER if first == "L" else _NUMBER if first == "N" else _OTHER
    # White_Space of Unicode: fixed values
    for code in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        kinds[code] = _SPACE
    return kinds


def piece_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of texts joined in ``chars`` (code points) begin; ``first``: where each non-empty text begins.

    The pattern: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of numbers or of other characters, each
    with at most one space before it; a run of white space without its last character if another piece follows.
    """
    n = len(chars)
    kind = _classes()[chars]
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n])  # white space right before something else
    start[last] = True
    start[last[chars[last] == 0x20] + 1] = False
    quote = np.flatnonzero((chars == 0x27) & start)
    quote = quote[(quote + 1 < n)]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = chars[quote + 1]
        two = np.where((quote + 2 < n) & ~head[np.minimum(quote + 2, n)], chars[np.minimum(quote + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, width in ((quote[single], 2), (quote[double], 3)):
            start[at + 1] = False
            after = at + width
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes texts with the vocabulary at ``path``; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        """Empties the memory of pieces. Its arrays have their full size from the start and take no memory until they are written to."""
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.char_at, self.char_n, self.id_at, self.id_n = (np.zeros(MEMO_PIECES, np.int32) for _ in range(4))
        self.chars, self.ids = np.zeros(MEMO_CHARS, np.uint32), np.zeros(MEMO_IDS, np.uint32)
        self.used = self.used_chars = self.used_ids = 0

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """By the library. Pieces are joined by line ends, which are pieces of their own, to save calls."""
        found: list[list[int] | None] = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if not p[-1].isspace()]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            got = self.library.encode("\n".join(pieces[i] for i in part), add_special_tokens=False)
            words, ids = np.array(got.word_ids, np.int64), got.ids
            if len(words) and words[-1] == 2 * len(part) - 2:
                cuts = np.searchsorted(words, np.arange(2 * len(part)))
                for k, i in enumerate(part):
                    found[i] = ids[cuts[2 * k] : cuts[2 * k + 1]]
        rest = [i for i, f in enumerate(found) if f is None]
        for i, got in zip(rest, self.library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = got.ids
        return found

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> bool:
        """Remember ``pieces`` under their sorted ``hashes``; False if they can't be held even by an empty memory."""
        if not pieces:
            return True
        ids = self._encode_pieces(pieces)
        chars = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        char_n, id_n = (np.array([*map(len, x)], np.int32) for x in (pieces, ids))
        n, n_ids = len(pieces), int(id_n.sum())
        if self.used + n > MEMO_PIECES or self.used_chars + len(chars) > MEMO_CHARS or self.used_ids + n_ids > MEMO_IDS:
            return False
        new = slice(self.used, self.used + n)
        self.char_n[new], self.id_n[new] = char_n, id_n
        self.char_at[new] = self.used_chars + np.cumsum(char_n) - char_n
        self.id_at[new] = self.used_ids + np.cumsum(id_n) - id_n
        self.chars[self.used_chars : self.used_chars + len(chars)] = chars
        self.ids[self.used_ids : self.used_ids + n_ids] = np.fromiter((x for p in ids for x in p), np.uint32, n_ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.places = np.insert(self.places, at, np.arange(self.used, self.used + n, dtype=np.int32))
        self.used, self.used_chars, self.used_ids = self.used + n, self.used_chars + len(chars), self.used_ids + n_ids
        return True

    def _by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                chars += len(texts[to])
                to += 1
            out += self._encode_some(texts[at:to])
            at = to
        return out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32) for _ in texts]
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.array([*map(len, texts)], np.int64)
        begin = np.cumsum(sizes) - sizes
        starts = piece_starts(chars, begin[sizes > 0])
        lengths = np.diff(starts, append=len(chars))
        inside = np.arange(len(chars)) - np.repeat(starts, lengths)
        power = np.cumprod(np.full(int(lengths.max()), _BASE))
        hashes = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * power[inside], starts)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = self._unknown(distinct)
        again = [whole[s : s + k] for s, k in zip(starts[where[new]].tolist(), lengths[where[new]].tolist(), strict=True)]
        if not self._learn(distinct[new], again):
            self._forget()
            every = [whole[s : s + k] for s, k in zip(starts[where].tolist(), lengths[where].tolist(), strict=True)]
            if not self._learn(distinct, every):
                return self._by_library(texts)
        piece = self.places[np.searchsorted(self.hashes, distinct)][back]
        right = self.char_n[piece] == lengths
        source = np.where(right, self.char_at[piece], 0).astype(np.int64)
        same = self.chars[np.minimum(np.repeat(source, lengths) + inside, len(self.chars) - 1)] == chars
        counts = self.id_n[piece].astype(np.int64)
        total = np.cumsum(counts)
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.id_at[piece] - (total - counts), counts)]
        # the first piece of each text; empty texts take none
        edges = np.searchsorted(starts, np.append(begin, len(chars)))
        cuts = np.append(0, total)[edges]
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if not (right.all() and same.all()):
            bad = np.unique(np.searchsorted(begin, np.append(np.flatnonzero(~same), starts[~right]), "right") - 1)
            for i in bad.tolist():
                out[i] = self._by_library([texts[i]])[0]
        return out

    def _unknown(self, keys: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of the hashes that aren't remembered."""
        if not self.used:
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.hashes, keys), self.used - 1)
        return np.flatnonzero(self.hashes[at] != keys)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)
