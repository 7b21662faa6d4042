"""JPEG against a plain decoder of the standard."""

import struct

import numpy as np
import pytest

from rasterloom.sources import jpeg


def decode(data: bytes) -> np.ndarray:
    """Baseline, components of full size: bit by bit, block by block."""
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    at, quant, trees = 2, {}, {}
    while True:
        mark, size = struct.unpack(">HH", data[at : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFFDB:
            quant[body[0]] = body[1:65]
        elif mark == 0xFFC4:
            number, values, code, k, tree = body[1:17], body[17:], 0, 0, {}
            assert len(values) == sum(number)
            for long, count in enumerate(number, 1):
                for _ in range(count):
                    assert code < (1 << long) - 1, "a code of ones only"
                    tree[long, code] = values[k]
                    code, k = code + 1, k + 1
                code <<= 1
            trees[body[0]] = tree
        elif mark == 0xFFC0:
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * i], body[8 + 3 * i]) for i in range(n)]
        elif mark == 0xFFDA:
            tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    stream = data[at:-2].replace(b"\xff\x00", b"\xff")
    bits, p = np.unpackbits(np.frombuffer(stream, np.uint8)).tolist(), 0

    def symbol(tree):
        nonlocal p
        code = n = 0
        while (n, code) not in tree:
            code, n, p = code << 1 | bits[p], n + 1, p + 1
        return tree[n, code]

    def value(n):
        nonlocal p
        v = int("".join(map(str, bits[p : p + n])) or "0", 2)
        p += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    order, x, y, up = [], 0, 0, True
    for _ in range(64):
        order.append((y, x))
        if up:
            if x == 7:
                y, up = y + 1, False
            elif y == 0:
                x, up = x + 1, False
            else:
                y, x = y - 1, x + 1
        elif y == 7:
            x, up = x + 1, True
        elif x == 0:
            y, up = y + 1, True
        else:
            y, x = y + 1, x - 1
    wave = np.array([[np.cos((2 * i + 1) * k * np.pi / 16) * (0.5 if k else 8**-0.5) for k in range(8)] for i in range(8)])
    out, last = np.zeros((n, h + -h % 8, w + -w % 8)), [0] * n
    for j in range(0, h, 8):
        for i in range(0, w, 8):
            for c, (name, q) in enumerate(parts):
                block = np.zeros((8, 8))
                last[c] += value(symbol(trees[tables[name] >> 4]))
                block[0, 0] = last[c] * quant[q][0]
                k = 1
                while k < 64:
                    s = symbol(trees[0x10 | tables[name] & 15])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[order[k]] = value(s & 15) * quant[q][k]
                    k += 1
                out[c, j : j + 8, i : i + 8] = wave @ block @ wave.T
    assert len(bits) - p < 8 and all(bits[p:])
    out = out[:, :h, :w]
    if n == 1:
        return np.clip(np.rint(out[0] + 128), 0, 255)
    y, b, r = out[0] + 128, out[1], out[2]
    return np.clip(np.rint(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=2)), 0, 255)


def picture(h, w, channels):
    y, x = np.mgrid[:h, :w]
    planes = [127 + 100 * np.sin(x / 11 + k) * np.cos(y / (7 + k)) for k in range(channels)]
    out = np.clip(np.stack(planes, axis=2), 0, 255).astype(np.uint8)
    return out[:, :, 0] if channels == 1 else out


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("shape", [(64, 64), (1, 1), (17, 9), (40, 33)])
def test_smooth(shape, channels):
    image = picture(*shape, channels)
    off = np.abs(decode(jpeg.encode(image, 95)).astype(float) - image)
    assert off.mean() < 1.5 and off.max() <= 12


def test_noise_and_flat():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 256, (48, 48, 3)).astype(np.uint8)
    grey = rng.integers(0, 256, (48, 48)).astype(np.uint8)
    assert np.abs(decode(jpeg.encode(grey, 100)) - grey).max() <= 3
    assert np.abs(decode(jpeg.encode(noise, 100)) - noise).max() <= 6
    sizes = [len(jpeg.encode(noise, q)) for q in (10, 50, 90)]
    assert sizes == sorted(sizes)
    for v in (0, 77, 255):
        flat = np.full((16, 24), v, np.uint8)
        assert np.abs(decode(jpeg.encode(flat, 85)) - v).max() <= 1
    assert (decode(jpeg.encode(np.where(np.arange(64) % 16 == 15, 255, 0).astype(np.uint8).reshape(8, 8), 100)) >= 0).all()


def test_code_lengths():
    """Lengths of very uneven counts are cut to 16 bits, remain a code, and are the best where nothing is cut."""
    uneven = {i: 2**i for i in range(40)}
    lengths = jpeg.code_lengths(uneven)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
    assert jpeg.code_lengths({5: 9}) == {5: 1}
    even = jpeg.code_lengths(dict.fromkeys(range(200), 1))
    assert set(even.values()) <= {7, 8} and len(even) == 200


@pytest.mark.parametrize("bad", [np.zeros((4, 4)), np.zeros((4, 4, 2), np.uint8), np.zeros((0, 4), np.uint8)])
def test_refused(bad):
    with pytest.raises(ValueError):
        jpeg.encode(bad)
