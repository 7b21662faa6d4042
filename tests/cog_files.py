"""Small tiled TIFF files of every form that the reader knows, for the tests."""

import struct
import zlib

import numpy as np


def lzw(data: bytes) -> bytes:
    """TIFF's LZW, by the textbook."""
    codes, table, text = [(256, 9)], {bytes([i]): i for i in range(256)}, b""
    size, width = 258, 9
    for byte in data:
        more = text + bytes([byte])
        if more in table:
            text = more
            continue
        codes.append((table[text], width))
        table[more] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size == 4094:
            codes.append((256, width))
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        text = bytes([byte])
    if text:
        codes.append((table[text], width))
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def predicted(block: np.ndarray, predictor: int) -> bytes:
    """block: (tile, tile, samples) in the file's byte order."""
    if predictor == 1:
        return block.tobytes()
    if predictor == 2:
        u = block.view(np.dtype(f"{block.dtype.byteorder if block.itemsize > 1 else '|'}u{block.itemsize}"))
        out = u.copy()
        out[:, 1:] = u[:, 1:] - u[:, :-1]
        return out.tobytes()
    high = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8)
    tile, _, samples = block.shape
    planes = high.reshape(tile, tile * samples, block.itemsize).transpose(0, 2, 1).reshape(tile, tile * block.itemsize, samples)
    out = planes.copy()
    out[:, 1:] = planes[:, 1:] - planes[:, :-1]
    return out.tobytes()


def write_cog(path, levels, origin, cell, tile=256, deflate=False, compression=None, predictor=1, big=False, order="<", planar=1):
    """One array (height, width[, samples]) for each level, the finest first. big: the form with 8-byte places."""
    kinds = {"u": 1, "i": 2, "f": 3}
    compression = compression or (8 if deflate else 1)
    pack = {8: zlib.compress, 5: lzw, 1: bytes}[compression]
    word, entry, room = ("Q", 20, 8) if big else ("I", 12, 4)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}H", 43 if big else 42))
    out += struct.pack(f"{order}HHQ", 8, 0, 0) if big else bytes(4)
    link = len(out) - room
    for k, a in enumerate(levels):
        a = a if a.ndim == 3 else a[:, :, None]
        a = a.astype(a.dtype.newbyteorder(order) if a.itemsize > 1 else a.dtype)
        h, w, samples = a.shape
        offsets, counts = [], []
        for plane in [a] if planar == 1 else [a[:, :, i : i + 1] for i in range(samples)]:
            for r in range(0, h, tile):
                for c in range(0, w, tile):
                    block = np.zeros((tile, tile, plane.shape[2]), a.dtype)
                    part = plane[r : r + tile, c : c + tile]
                    block[: part.shape[0], : part.shape[1]] = part
                    data = pack(predicted(block, predictor))
                    offsets.append(len(out))
                    counts.append(len(data))
                    out += data
        tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [a.itemsize * 8] * samples), (259, "H", [compression]), (277, "H", [samples]), (284, "H", [planar]), (317, "H", [predictor])]
        tags += [(322, "I", [tile]), (323, "I", [tile]), (324, word, offsets), (325, "I", counts), (339, "H", [kinds[a.dtype.kind]] * samples)]
        if k == 0:
            tags += [(33550, "d", [cell, cell, 0.0]), (33922, "d", [0.0, 0.0, 0.0, origin[0], origin[1], 0.0])]
        entries = []
        for tag, code, values in tags:
            data = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(data) > room:
                at, _ = len(out), out.extend(data)
                data = struct.pack(f"{order}{word}", at)
            entries.append(struct.pack(f"{order}HH{word}", tag, {"H": 3, "I": 4, "d": 12, "Q": 16}[code], len(values)) + data.ljust(room, b"\0"))
        struct.pack_into(f"{order}{word}", out, link, len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(room)
    with open(path, "wb") as file:
        file.write(out)
