"""Byte, date, type and geometry functions as column expressions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: Cell types, their bytes, numpy code and promotion priority.
DTYPES = {
    "int8raw": (1, "i1", 1), "uint8raw": (1, "u1", 1), "int8": (1, "i1", 1), "uint8": (1, "u1", 1),
    "int16raw": (2, "<i2", 1), "uint16raw": (2, "<u2", 1), "int16": (2, "<i2", 1), "uint16": (2, "<u2", 1),
    "int32raw": (4, "<i4", 1), "int32": (4, "<i4", 1), "float32raw": (4, "<f4", 2), "float32": (4, "<f4", 2),
    "float64raw": (8, "<f8", 3), "float64": (8, "<f8", 3),
}
#: The forms of a time, in the order they are tried.
TIME_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")


def parse_time(text: Column) -> Column:
    """The first form that fits, a date as its first second, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMS]).cast("timestamp_ntz")


def priority(dtype: Column) -> Column:
    out = F.lit(None).cast("int")
    for level in (1, 2, 3):
        out = F.when(dtype.isin([k for k, v in DTYPES.items() if v[2] == level]), level).otherwise(out)
    return out


def promote(a: Column, b: Column) -> Column:
    """Common cell type of two: whole numbers int32raw, single precision float32raw, else float64raw."""
    p = F.greatest(priority(a), priority(b))
    known = priority(a).isNotNull() & priority(b).isNotNull()
    return F.when(known & (p == 1), "int32raw").when(known & (p == 2), "float32raw").when(known, "float64raw")


def little_endian(data: Column, start: int, size: int) -> Column:
    """Unsigned integer of `size` (up to 7) bytes from byte `start` (from 1), the lowest first."""
    digits = F.hex(data)
    pairs = [F.substring(digits, 2 * (start + i) - 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def wkt_envelope(wkt: Column) -> Column:
    """Extent of a WKT geometry: the least and greatest of its coordinates."""
    number = r"(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)"
    xs = F.transform(F.regexp_extract_all(wkt, F.lit(f"{number} +{number}"), F.lit(1)), lambda v: v.cast("double"))
    ys = F.transform(F.regexp_extract_all(wkt, F.lit(f"{number} +{number}"), F.lit(2)), lambda v: v.cast("double"))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def wkb_envelope(text: Column) -> Column:
    """Extent of a geometry as hexadecimal WKB, little- or big-endian, with or without an SRID, of two dimensions."""

    @F.pandas_udf("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 4 if t is None else bounds(wkb_points(bytes.fromhex(t))) for t in s], columns=["xmin", "ymin", "xmax", "ymax"])

    return run(text)


def bounds(points: np.ndarray) -> tuple:
    return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist()) if len(points) else (None,) * 4


def wkb_points(data: bytes) -> np.ndarray:
    """All coordinates of a geometry in well-known binary form (points, lines, polygons and collections of them)."""
    found, at = [], 0

    def number(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", data, at - 4)[0]

    def points(order: str, n: int) -> None:
        nonlocal at
        found.append(np.frombuffer(data, f"{order}f8", 2 * n, at).reshape(n, 2))
        at += 16 * n

    def geometry() -> None:
        nonlocal at
        order = "<" if data[at] else ">"
        at += 1
        kind = number(order)
        if kind & 0x20000000:
            number(order)  # the SRID
        kind &= 0xFF
        if kind == 1:
            points(order, 1)
        elif kind == 2:
            points(order, number(order))
        elif kind == 3:
            for _ in range(number(order)):
                points(order, number(order))
        else:
            for _ in range(number(order)):
                geometry()

    geometry()
    return np.concatenate(found) if found else np.zeros((0, 2))


def envelope(geometry: Column) -> Column:
    """Extent of a geometry as WKT or hexadecimal WKB, told apart by the first characters."""
    is_wkb = geometry.rlike("^0[01][0-9A-Fa-f]{8}")
    return F.coalesce(F.when(~is_wkb, wkt_envelope(geometry)), wkb_envelope(F.when(is_wkb, geometry)))


def new_id() -> Column:
    """A random UUID for each row."""
    return F.uuid()


def strip(cells: Column, width: int, row: int, col: int, rows: int, cols: int) -> Column:
    """A block of a row-major array of cells."""
    parts = [F.slice(cells, (row + i) * width + col + 1, cols) for i in range(rows)]
    return F.concat(*parts)
