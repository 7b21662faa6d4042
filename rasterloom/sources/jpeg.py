"""Baseline JPEG of 8-bit images, on numpy arrays of all blocks at once.

Colours go to luminance and two differences, each of full size. Blocks of 8 x 8 are transformed (discrete cosine), quantised,
read in zigzag order and written as runs and values under Huffman codes that are made for the image: code lengths by its own
symbol counts, at most 16 bits. Nothing is written symbol by symbol in Python: runs, codes and bits are arrays.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# The quantisation steps that the standard recommends at quality 50, row by row
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
COLOUR = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of a block in the order in which diagonals are read, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Rows of the orthonormal cosine transform.
COSINE = np.array([[(0.5 if k else 0.125**0.5) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


def steps(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255).astype(int)


def blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients (blocks, 64) of a plane around 0, in zigzag order; edges are repeated to whole blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    cut = plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    made = np.einsum("ij,bjk,lk->bil", COSINE, cut, COSINE, optimize=True).reshape(-1, 64)
    return np.rint(made / table).astype(np.int64)[:, ZIGZAG]


def size_of(v: np.ndarray) -> np.ndarray:
    """Bits of a value's magnitude."""
    return np.frexp(np.abs(v).astype(float))[1].astype(np.int64)


def symbols(coefficients: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, whether of the first coefficient, symbol, bits after it, their number), in the order of writing. Of every
    `stride` blocks in turn each has its own first coefficients' differences."""
    n = len(coefficients)
    first = coefficients[:, 0].copy()
    first[stride:] -= coefficients[:-stride, 0]
    b, k = np.nonzero(coefficients[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], b[1:] != b[:-1]]), 0, np.concatenate([[0], k[:-1]])) if len(b) else k
    run, v = k - before - 1, coefficients[b, k]
    long = run // 16
    extra = np.repeat(np.arange(len(b)), long)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, b, k)
    ends = np.flatnonzero(last < 63)
    # one list of symbols, brought into order by block, place and, of runs of sixteen zeros, before the value they lead to
    block = np.concatenate([np.arange(n), b[extra], b, ends])
    place = np.concatenate([np.zeros(n, np.int64), 2 * k[extra] - 1, 2 * k, np.full(len(ends), 200)])
    value = np.concatenate([first, np.zeros(len(extra), np.int64), v, np.zeros(len(ends), np.int64)])
    size = size_of(value)
    symbol = np.concatenate([size[:n], np.full(len(extra), 0xF0), (run % 16) * 16 + size_of(v), np.zeros(len(ends), np.int64)])
    order = np.lexsort((place, block))
    bits = np.where(value < 0, value + (1 << size) - 1, value)
    return block[order], place[order] == 0, symbol[order], bits[order], size[order]


def code_lengths(counts: dict[int, int], most: int = 16) -> dict[int, int]:
    """Huffman code lengths, none above `most`, and no code of ones only."""
    # a symbol that never occurs takes the code of ones
    heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, 1 << 20, [-1])]
    heapq.heapify(heap)
    depth = dict.fromkeys([*counts, -1], 0)
    while len(heap) > 1:
        (n, i, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            depth[s] += 1
        heapq.heappush(heap, (n + m, i + (1 << 21), a + b))
    number = np.bincount(list(depth.values()), minlength=most + 2)
    # too long ones: two leaves of the last length become one a step up, paid for by a leaf higher up that is split
    for d in range(len(number) - 1, most, -1):
        while number[d] > 0:
            j = d - 2
            while number[j] == 0:
                j -= 1
            number[d] -= 2
            number[d - 1] += 1
            number[j] -= 1
            number[j + 1] += 2
    lengths = np.repeat(np.arange(len(number)), number).tolist()
    ranked = sorted(depth, key=lambda s: (s == -1, depth[s], s))
    return {s: n for s, n in zip(ranked, lengths) if s != -1}


def huffman(symbol: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as it is written, and the code and length of each symbol."""
    values, counts = np.unique(symbol, return_counts=True)
    lengths = code_lengths(dict(zip(values.tolist(), counts.tolist())))
    ranked = sorted(lengths, key=lambda s: (lengths[s], s))
    code, at, codes, sizes = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in ranked:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s], sizes[s] = code, at
        code += 1
    number = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return number + bytes(ranked), codes, sizes


def bits_of(words: np.ndarray, lengths: np.ndarray) -> bytes:
    """Words of so many bits, one after the other, filled up with ones; a byte of ones is followed by one of zeros."""
    end = np.cumsum(lengths)
    total = int(end[-1])
    left = np.repeat(end, lengths) - np.arange(total) - 1
    out = (np.repeat(words, lengths) >> left) & 1
    data = np.packbits(np.concatenate([out, np.ones(-total % 8, np.int64)]).astype(np.uint8)).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def encode(image: np.ndarray, quality: int = 85) -> bytes:
    """JPEG of 8-bit grey (height, width) or colours (height, width, 3)."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or (image.ndim == 3 and image.shape[2] != 3) or not image.size or not 1 <= quality <= 100:
        raise ValueError("an image of 8-bit grey or three colours, and a quality from 1 to 100")
    if image.ndim == 2:
        planes = [image.astype(float) - 128]
    else:
        r, g, b = (image[:, :, i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    tables = [steps(LUMINANCE, quality), steps(COLOUR, quality)][: 1 if len(planes) == 1 else 2]
    made = [blocks(p, tables[min(i, 1) if i else 0]) for i, p in enumerate(planes)]
    n = len(made)
    # one block of each plane in turn
    every = np.stack(made, axis=1).reshape(-1, 64)
    block, first, symbol, bits, size = symbols(every, n)
    kind = np.minimum(block % n, 1)
    words, lengths, head = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64), []
    for k in range(len(tables)):
        for ac in (0, 1):
            own = (kind == k) & (first == (ac == 0))
            table, codes, sizes = huffman(symbol[own])
            words[own] = (codes[symbol[own]] << size[own]) | bits[own]
            lengths[own] = sizes[symbol[own]] + size[own]
            head.append(bytes([ac << 4 | k]) + table)
    segment = lambda mark, data: struct.pack(">BBH", 0xFF, mark, len(data) + 2) + data
    height, width = image.shape[:2]
    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    parts += [segment(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(tables)]
    parts.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(n))))
    parts += [segment(0xC4, t) for t in head]
    parts.append(segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, min(i, 1) * 0x11]) for i in range(n)) + b"\0\x3f\0"))
    return b"".join([*parts, bits_of(words, lengths), b"\xff\xd9"])
