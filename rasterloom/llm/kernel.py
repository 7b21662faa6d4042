"""Array kernels on the bytes of Arrow string columns, shared by the text operators.

Words are maximal runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return. None of
these occurs inside a multi-byte UTF-8 sequence, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Base of the polynomial word hash (odd, 5 modulo 8) and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 5 & ~2
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_CODE = BYTE_CODE[LOWER]

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse; kept and grown by doubling."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(19, int(n).bit_length())
        both = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _powers = both[0], both[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets into them; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    at = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(sizes: np.ndarray, limit: int = 1 << 19):
    """Ranges (lo, hi) of consecutive rows whose sizes add up to about limit; a larger row stands alone."""
    lo, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)


def text_chunks(col: pa.Array, limit: int = 1 << 19):
    """(lo, hi, bytes, offsets) for consecutive rows of a string column, about limit bytes at a time."""
    raw, at = string_bytes(col)
    for lo, hi in chunks(np.diff(at), limit):
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each row (n+1 values)."""
    inside = IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(final) + 1, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, of its lower-cased (A-Z) bytes if asked."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((LOWER_CODE if lower else BYTE_CODE)[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width words within a row, and their row. first: words before each row (n+1).

    A row with fewer words, but at least one, has one shingle: all its words.
    """
    n = np.diff(first)
    step = U64(0xD6E8FEB86659FD93)
    rows = np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))
    full = np.zeros(0, U64)
    if len(rows):
        run = np.zeros(len(words) - width + 1, U64)
        for k in range(width):
            run = run * step + words[k : k + len(run)]
        keep = np.ones(len(run), bool)
        for k in range(1, width):
            cut = first[1:] - k
            keep[cut[(cut >= 0) & (cut < len(run)) & (first[1:] > first[:-1])]] = False
        # a row shorter than width starts no run of its own
        for i in np.flatnonzero((n > 0) & (n < width)):
            keep[first[i] : min(first[i + 1], len(run))] = False
        full = mix(run[keep])
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        h = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = n[short] > k
            h[has] = h[has] * step + words[first[short[has]] + k]
        h = mix(h + n[short].astype(U64))
        rows, full = np.concatenate([rows, short]), np.concatenate([full, h])
    return full, rows


def distinct_sorted(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row and then hash, and the number before each row (n+1)."""
    order = np.argsort(h, kind="stable")
    kind = np.uint16 if n < 65536 else np.int64
    order = order[np.argsort(rows[order].astype(kind), kind="stable")]
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(n + 1))


def set_hash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set of hashes, whatever their order."""
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(0xA5A5A5A55A5A5A5A)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(U64))
