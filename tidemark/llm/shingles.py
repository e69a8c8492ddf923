"""Sets of word shingles as sorted arrays of 64-bit hashes, computed over whole batches of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_MUL = np.uint64(0xFF51AFD7ED558CCD)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MUL
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(_ODD)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, np.uint64(x)), dtype=np.uint64)]) for x in (_ODD, _INVERSE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n at least of the odd base modulo 2**64, and of its inverse."""
    return _powers(max(16, int(n).bit_length()))


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of a[i:j], times the base to the i."""
    up, _ = powers(len(a))
    return np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], dtype=np.uint64)])


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word of ``[^\\x20\\x09-\\x0D]+``."""
    a = np.frombuffer(text, np.uint8)
    word = ~((a == 32) | ((a >= 9) & (a <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    _, down = powers(len(a))
    p = prefix_hash(a)
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, A-Z lower-cased.

    A text of fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    low = [t.lower() if t else b"" for t in texts]
    whole = word_hashes(b"\n".join(low))
    counts = np.fromiter((len(t.split()) for t in low), np.int64, len(low))
    ends = np.cumsum(counts)
    n = max(0, len(whole) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(_ODD) + whole[j : j + n])
    out = []
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(h[lo : hi - k + 1]))
        elif hi > lo:
            s = np.full(1, np.uint64(hi - lo))
            for w in whole[lo:hi]:
                s = mix(s * np.uint64(_ODD) + w)
            out.append(s)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
