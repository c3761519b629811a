"""Word shingles of a batch of texts as 64-bit hashes, computed with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[128:] = True
_BATCH_BYTES = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words in order: A-Z lower-cased; ASCII other than letters and digits separates."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at < len(texts) and (not part or held < _BATCH_BYTES):
            part.append(texts[at].encode().lower() + b" ")
            held += len(part[-1])
            at += 1
        data = np.frombuffer(b"".join(part), np.uint8)
        inside = _IN_WORD[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            out += [np.zeros(0, np.uint64)] * len(part)
            continue
        kept = np.flatnonzero(inside)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(kept)) - np.repeat(first, lengths)
        power = np.cumprod(np.full(int(lengths.max()), _B1))
        hashes = mixed(np.add.reduceat((data[kept].astype(np.uint64) + np.uint64(1)) * power[place], first))
        cuts = np.searchsorted(starts, np.append(0, np.cumsum([len(p) for p in part])))
        out += [hashes[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of ``size`` words in a row, in order; a text of fewer words, but not none, is one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            power = power * _B2
            total += words[k : k + n] * power
    return mixed(total)
