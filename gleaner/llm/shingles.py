"""Vectorised words, shingle sets and similarity sketches of many texts at once (numpy over Arrow buffers)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U) | U(1)
_BASE = int(_RNG.integers(0, 2**63, dtype=np.int64)) | 1
_PLACE = _RNG.integers(0, 2**64, 16, dtype=U) | U(1)
_SHORT = _RNG.integers(0, 2**64, 16, dtype=U)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Texts are taken together up to this many bytes; a longer text is taken whole, alone.
CHUNK_BYTES = 1_000_000
_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, twice)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse; those for chunks of the usual size are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    m = max(n, CHUNK_BYTES + 2)
    made = [np.concatenate(([U(1)], np.cumprod(np.full(m - 1, b, dtype=U)))) for b in (_BASE, pow(_BASE, -1, 2**64))]
    if m == CHUNK_BYTES + 2:
        _powers[:] = made
    return made[0], made[1]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    # The offsets and bytes of the Arrow column as they are: texts are not copied.
    off = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each row); A-Z count as a-z if ``fold``."""
    n = len(data)
    rows = len(off) - 1
    if not n:
        return np.zeros(0, dtype=U), np.zeros(rows, dtype=np.int64)
    data = _FOLD[data] if fold else data
    blank = _BLANK[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, blank[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, blank[1:]
    start = np.flatnonzero(~blank & (before | edge[:-1]))
    end = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = _power(n + 1)
    total = np.empty(n + 1, dtype=U)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
    return h, np.diff(np.searchsorted(start, off))


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, row after row; their number in each row).

    A row of fewer than ``k`` words has its whole sequence as its one shingle; a row without words has none.
    """
    first = np.concatenate(([0], np.cumsum(counts)))
    row = np.repeat(np.arange(len(counts)), counts)
    if len(h) >= k:
        at = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
        s = np.zeros(len(at), dtype=U)
        for j in range(k):
            s += mix(h[at + j] * _PLACE[j])
        s, of = mix(s), row[at]
    else:
        s, of = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        t = _SHORT[counts[short]].copy()
        for j in range(k - 1):
            has = counts[short] > j
            t[has] += mix(h[first[short[has]] + j] * _PLACE[j])
        s, of = np.concatenate((s, mix(t))), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    bounds = np.searchsorted(of, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            s[a:b].sort()
    new = np.ones(len(s), dtype=bool)
    if len(s) > 1:
        new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], np.bincount(of[new], minlength=len(counts)).astype(np.int64)


def sketches(s: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, ``t`` coordinates a row (``t`` a power of two).

    Round ``i`` below ``t`` places every element by its own hash in one of ``t`` bins, and a bin that is still empty takes
    the least value placed in it; round ``t + j`` places every element in bin ``j``. Rows leave as soon as all bins are
    full, so a row of many elements needs a round or two, and every coordinate of a non-empty row is filled at the end.
    Two rows agree on a coordinate with probability equal to their Jaccard similarity, with concentration as for
    independent samples.
    """
    rows, bits = len(sizes), t.bit_length() - 1
    out = np.zeros((rows, t), dtype=U)
    full = np.zeros((rows, t), dtype=bool)
    todo = sizes > 0
    row = np.repeat(np.arange(rows), sizes)
    x, of = s, row
    none = U(2**64 - 1)
    for i in range(2 * t):
        if i:
            live = todo[of]
            if not live.all():
                x, of = x[live], of[live]
        if not len(x):
            break
        seen = np.flatnonzero(todo)
        place = np.empty(rows, dtype=np.int64)
        place[seen] = np.arange(len(seen))
        v = mix(x, i + 1)
        least = np.full(len(seen) * t, none, dtype=U)
        b = (v >> U(64 - bits)).astype(np.int64) if i < t else np.full(len(x), i - t, dtype=np.int64)
        np.minimum.at(least, place[of] * t + b, v)
        least = least.reshape(len(seen), t)
        take = (least != none) & ~full[seen]
        out[seen] = np.where(take, mix(least, 1000 + i), out[seen])
        full[seen] |= take
        todo[seen] = ~full[seen].all(axis=1)
    return out


#: Words of 64 bits in the bitmap of a set at most; larger sets share bits, which weakens the bound but not its truth.
MOST_WORDS = 512


def bitmaps(s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits, row after row; their number in each row): the bit of every element's hash in a bitmap of a power of two
    words, of two bits an element or more up to ``MOST_WORDS``. A row without elements has one word."""
    need = np.maximum(np.ceil(2 * sizes / 64), 1)
    width = np.minimum(2 ** np.ceil(np.log2(need)).astype(np.int64), MOST_WORDS)
    first = np.concatenate(([0], np.cumsum(width))) * 64
    row = np.repeat(np.arange(len(sizes)), sizes)
    flags = np.zeros(int(first[-1]), dtype=bool)
    flags[first[row] + (mix(s, 5) & (width[row] * 64 - 1).astype(U)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(U), width


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (last axis) brought to ``width`` words: the bits of the same sets in a smaller bitmap."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def most_in_common(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most elements that sets of ``n`` and ``m`` elements with bitmaps ``x`` and ``y`` can share. Never less than what they do
    share: each bit that only one bitmap has stands for at least one element that the other set lacks."""
    width = min(x.shape[-1], y.shape[-1])
    x, y = folded(x, width), folded(y, width)
    return np.minimum(n - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
