"""Vectorised byte kernels: window hashes, 5-word shingles, window minimisers."""
from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x5851F42D4C957F2D  # any odd number
_MIX = U(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 21, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place where it can)."""
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= _MIX
    h ^= h >> U(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:len(data)], out=sums[1:])
    return sums


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at every position of ``data``."""
    sums = prefix_sums(data)
    _, down = _powers(len(data) + 1)
    return mix((sums[k:] - sums[:-k]) * down[:len(data) - k + 1])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values (two block-wise running minima)."""
    n = len(v)
    padded = np.full(-(-n // w) * w, ~U(0))
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    fwd = np.minimum.accumulate(blocks, axis=1).ravel()
    bwd = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(bwd[:n - w + 1], fwd[w - 1:n])


# -- words and shingles ------------------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_STEP = [U(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                        0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and the offsets of each row's words.

    ``offsets`` start at 0 and end at ``len(data)``; words never cross rows.
    """
    n = len(data)
    if not n:
        return np.empty(0, U), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = prefix_sums(_LOWER[data])
    _, down = _powers(n + 1)
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
    return h, np.searchsorted(s, offsets)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every line, its newline included, and the offsets of each row's lines.

    ``offsets`` are as in ``word_hashes``. What follows a row's last newline is
    a line, even if empty.
    """
    newline = np.flatnonzero(data == 10) + 1
    seen = np.searchsorted(newline, offsets, side="right")
    lo = seen + np.arange(len(offsets))
    cuts = np.zeros(int(lo[-1]), bool)
    cuts[lo[:-1]] = True
    s = np.empty(len(cuts), np.int64)
    s[cuts], s[~cuts] = offsets[:-1], newline
    e = np.empty_like(s)
    e[:-1] = s[1:]
    e[lo[1:] - 1] = offsets[1:]
    sums = prefix_sums(data)
    _, down = _powers(len(data) + 1)
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U)), lo


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of every row, concatenated, and their offsets.

    A row of fewer words gives its whole word sequence as one shingle; a row
    without words gives none.
    """
    words, wo = word_hashes(data, offsets)
    grams = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        grams += words[j:j + len(grams)] * _STEP[j % 5] + U(j)
    grams = mix(grams)
    out, sizes = [], np.zeros(len(offsets), np.int64)
    for i in range(len(offsets) - 1):
        a, b = int(wo[i]), int(wo[i + 1])
        if b - a >= k:
            g = np.sort(grams[a:b - k + 1])
            if len(g) > 1:
                g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            g = np.array([b - a], U)
            for j in range(a, b):
                g = mix(g * _STEP[(j - a) % 5] + words[j:j + 1])
        else:
            continue
        out.append(g)
        sizes[i + 1] = len(g)
    return (np.concatenate(out) if out else np.empty(0, U)), np.cumsum(sizes)


# -- sorting -----------------------------------------------------------------
def multikey_quicksort(words: list[np.ndarray], leaf: int = 64) -> np.ndarray:
    """Order of rows whose keys are sequences of machine words.

    Three-way partition on one word at a time: the equal part moves on to the
    next word, the others stay at the same one. Ranges of ``leaf`` rows or
    fewer are ordered directly. Equal keys keep their input order.
    """
    n, out = len(words[0]), []
    todo = [(np.arange(n), 0)]
    while todo:
        idx, depth = todo.pop()
        if depth == len(words) or len(idx) < 2:
            out.append(idx)
            continue
        if len(idx) <= leaf:
            out.append(idx[np.lexsort([w[idx] for w in reversed(words[depth:])])])
            continue
        key = words[depth][idx]
        pivot = np.sort(key[[0, len(key) // 4, len(key) // 2, 3 * len(key) // 4, -1]])[2]
        todo.append((idx[key > pivot], depth))
        todo.append((idx[key == pivot], depth + 1))
        todo.append((idx[key < pivot], depth))
    return np.concatenate(out) if out else np.empty(0, np.int64)
