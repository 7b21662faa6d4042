"""Coordinate systems from their definitions, as column expressions or on numpy arrays.

`system` reads an EPSG code, a PROJ string or a WKT string. The same formulas serve both forms: they take the module that
has the functions (`F`, the default, or `ARRAYS`). Transverse Mercator is by Krueger's series to the sixth order in the third
flattening; Lambert's conformal conic (one or two parallels), Albers' equal-area conic, polar stereographic and Mercator are
the usual closed forms on the ellipsoid (Snyder, 1987), their inverse latitudes by series. A datum that is shifted against
WGS 84 goes through geocentric coordinates by three or seven parameters (position vector).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

ARRAYS = SimpleNamespace(
    sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2, sinh=np.sinh, cosh=np.cosh, asinh=np.arcsinh, atanh=np.arctanh,
    exp=np.exp, ln=np.log, sqrt=np.sqrt, pow=np.power, radians=np.radians, degrees=np.degrees,
)

# Ellipsoids (half axis in metres, inverse flattening; 0 for a sphere)
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "intl": (6378388.0, 297.0), "bessel": (6377397.155, 299.1528128),
    "clrk66": (6378206.4, 294.978698214), "krass": (6378245.0, 298.3), "airy": (6377563.396, 299.3249646), "sphere": (6370997.0, 0.0),
}
DATUMS = {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66"}
# Definitions of codes that are no member of a numbered series
CODES = {
    4326: "+proj=longlat +datum=WGS84", 4490: "+proj=longlat +ellps=GRS80", 4269: "+proj=longlat +datum=NAD83", 3857: "+proj=webmerc +datum=WGS84", 3395: "+proj=merc +datum=WGS84",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84", 3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +datum=WGS84", 3995: "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0 +datum=WGS84",
    5070: "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +datum=NAD83", 2154: "+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=3 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    27700: "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489",
}

# Coefficients of the third flattening's powers (first row: of power 1, 2, ...; second: of 2, 3, ...; and so on)
TO_GRID = [
    [1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800], [13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360], [61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440],
    [49561 / 161280, -179 / 168, 6601661 / 7257600], [34729 / 80640, -3418889 / 1995840], [212378941 / 319334400],
]
FROM_GRID = [
    [1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800], [1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720], [17 / 480, -37 / 840, -209 / 4480, 5569 / 90720],
    [4397 / 161280, -11 / 504, -830251 / 7257600], [4583 / 161280, -108847 / 3991680], [20648693 / 638668800],
]
TO_LATITUDE = [
    [2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675], [7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945], [56 / 15, -136 / 35, -1262 / 105, 73814 / 2835],
    [4279 / 630, -332 / 35, -399572 / 14175], [4174 / 315, -144838 / 6237], [601676 / 22275],
]


def series(rows: list[list[float]], n: float) -> list[float]:
    return [sum(c * n ** (i + j + 1) for j, c in enumerate(row)) for i, row in enumerate(rows)]


@dataclass(frozen=True)
class Crs:
    """A coordinate system; angles in degrees, lengths in metres. unit: metres of one of its own units."""

    kind: str
    a: float = 6378137.0
    flat: float = 1 / 298.257223563
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float | None = None
    ts: float | None = None
    k: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    unit: float = 1.0
    shift: tuple = ()

    @property
    def e2(self) -> float:
        return self.flat * (2 - self.flat)

    # parts of the formulas, of angles in radians

    def isometric(self, phi, m):
        """Isometric latitude: the Mercator ordinate on the unit ellipsoid."""
        e = math.sqrt(self.e2)
        return m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi))

    def latitude(self, psi, m):
        """The latitude of an isometric latitude, by the conformal one."""
        chi = m.atan(m.sinh(psi))
        out = chi
        for j, c in enumerate(series(TO_LATITUDE, self.flat / (2 - self.flat)), 1):
            out = out + c * m.sin(2 * j * chi)
        return out

    def radius(self, phi: float) -> float:
        """Of the parallel at a latitude, on the unit ellipsoid."""
        return math.cos(phi) / math.sqrt(1 - self.e2 * math.sin(phi) ** 2)

    def authalic(self, phi, m):
        e, s = math.sqrt(self.e2), m.sin(phi)
        return 2 * s if not e else (1 - self.e2) * (s / (1 - self.e2 * s * s) + m.atanh(e * s) / e)

    def conic(self) -> tuple[float, float, float]:
        """Exponent, factor and the distance of the origin's parallel, for a conic system."""
        p0, p1, p2 = (math.radians(v) for v in (self.lat0, self.lat1, self.lat1 if self.lat2 is None else self.lat2))
        flat = abs(p1 - p2) < 1e-12
        if self.kind == "aea":
            q = [self.authalic(p, ARRAYS) for p in (p1, p2)]
            r = [self.radius(p) ** 2 for p in (p1, p2)]
            n = math.sin(p1) if flat else (r[0] - r[1]) / (q[1] - q[0])
            c = r[0] + n * q[0]
            return n, c, math.sqrt(c - n * self.authalic(p0, ARRAYS)) / n
        psi = [float(self.isometric(p, ARRAYS)) for p in (p1, p2)]
        n = math.sin(p1) if flat else math.log(self.radius(p1) / self.radius(p2)) / (psi[1] - psi[0])
        c = self.radius(p1) * math.exp(n * psi[0]) / n
        return n, c, c * math.exp(-n * float(self.isometric(p0, ARRAYS)))

    def polar(self) -> tuple[float, float]:
        """Sign of the pole and factor, for a polar stereographic system."""
        sign, e = math.copysign(1.0, self.lat0), math.sqrt(self.e2)
        if self.ts is None or abs(self.ts) >= 90:
            return sign, 2 * self.k / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        ts = math.radians(abs(self.ts))
        return sign, self.radius(ts) * math.exp(float(self.isometric(ts, ARRAYS)))

    def forward(self, lon, lat, m=F):
        """x and y of WGS 84 longitude and latitude in degrees."""
        lon, lat = self.shifted(lon, lat, m, 1)
        if self.kind == "longlat":
            return lon, lat
        phi, lam, k = m.radians(lat), m.radians(lon - self.lon0), self.a * self.k
        if self.kind == "webmerc":
            x, y = self.a * lam, self.a * m.atanh(m.sin(phi))
        elif self.kind == "merc":
            k = self.a * (self.radius(math.radians(self.ts)) if self.ts else self.k)
            x, y = k * lam, k * self.isometric(phi, m)
        elif self.kind == "tmerc":
            n = self.flat / (2 - self.flat)
            t = m.sinh(self.isometric(phi, m))
            xi, eta = m.atan2(t, m.cos(lam)), m.asinh(m.sin(lam) / m.sqrt(t * t + m.cos(lam) * m.cos(lam)))
            x, y = eta, xi
            for j, c in enumerate(series(TO_GRID, n), 1):
                x = x + c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
                y = y + c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            x, y = k * self.scale() * x, k * self.scale() * (y - self.meridian())
        elif self.kind in ("lcc", "aea"):
            n, c, rho0 = self.conic()
            rho = c * m.exp(-n * self.isometric(phi, m)) if self.kind == "lcc" else m.sqrt(c - n * self.authalic(phi, m)) / n
            x, y = k * rho * m.sin(n * lam), k * (rho0 - rho * m.cos(n * lam))
        else:
            sign, c = self.polar()
            rho = self.a * c * m.exp(-sign * self.isometric(phi, m))
            x, y = rho * m.sin(lam), -sign * rho * m.cos(lam)
        return (x + self.x0) / self.unit, (y + self.y0) / self.unit

    def inverse(self, x, y, m=F):
        """WGS 84 longitude and latitude in degrees of x and y."""
        if self.kind == "longlat":
            return self.shifted(x, y, m, -1)
        x, y, k = x * self.unit - self.x0, y * self.unit - self.y0, self.a * self.k
        if self.kind == "webmerc":
            lam, phi = x / self.a, m.atan(m.sinh(y / self.a))
        elif self.kind == "merc":
            k = self.a * (self.radius(math.radians(self.ts)) if self.ts else self.k)
            lam, phi = x / k, self.latitude(y / k, m)
        elif self.kind == "tmerc":
            n, s = self.flat / (2 - self.flat), k * self.scale()
            xi, eta = y / s + self.meridian(), x / s
            a, b = xi, eta
            for j, c in enumerate(series(FROM_GRID, n), 1):
                a = a - c * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
                b = b - c * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            lam, phi = m.atan2(m.sinh(b), m.cos(a)), self.latitude(m.atanh(m.sin(a) / m.cosh(b)), m)
        elif self.kind in ("lcc", "aea"):
            n, c, rho0 = self.conic()
            sign = math.copysign(1.0, n)
            x, y = sign * x / k, sign * (rho0 - y / k)
            rho, lam = m.sqrt(x * x + y * y), m.atan2(x, y) / n
            phi = self.latitude(-m.ln(rho * abs(1 / c)) / n, m) if self.kind == "lcc" else self.of_authalic((c - rho * rho * n * n) / n, m)
        else:
            sign, c = self.polar()
            rho, lam = m.sqrt(x * x + y * y), m.atan2(x, -sign * y)
            phi = self.latitude(-sign * m.ln(rho / (self.a * c)), m)
        return self.shifted(m.degrees(lam) + self.lon0, m.degrees(phi), m, -1)

    def of_authalic(self, q, m):
        e2, beta = self.e2, m.asin(q / self.authalic(math.pi / 2, ARRAYS))
        terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        return beta + terms[0] * m.sin(2 * beta) + terms[1] * m.sin(4 * beta) + terms[2] * m.sin(6 * beta)

    def scale(self) -> float:
        """Of a meridian's rectifying radius to the half axis."""
        n = self.flat / (2 - self.flat)
        return (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n)

    def meridian(self) -> float:
        """The rectifying latitude of the origin."""
        xi = math.atan(math.sinh(float(self.isometric(math.radians(self.lat0), ARRAYS))))
        return xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(series(TO_GRID, self.flat / (2 - self.flat)), 1))

    def shifted(self, lon, lat, m, way: int):
        """Degrees of WGS 84 on this datum (way 1) or back (-1)."""
        if not any(self.shift):
            return lon, lat
        ground = Crs("longlat")
        here, there = (ground, self) if way == 1 else (self, ground)
        dx, dy, dz, rx, ry, rz, ppm = (-way * v for v in (*self.shift, *[0.0] * (7 - len(self.shift))))
        rx, ry, rz = (math.radians(v / 3600) for v in (rx, ry, rz))
        phi, lam, s = m.radians(lat), m.radians(lon), 1 + ppm * 1e-6
        n = here.a / m.sqrt(1 - here.e2 * m.sin(phi) * m.sin(phi))
        x, y, z = n * m.cos(phi) * m.cos(lam), n * m.cos(phi) * m.sin(lam), n * (1 - here.e2) * m.sin(phi)
        x, y, z = dx + s * (x - rz * y + ry * z), dy + s * (rz * x + y - rx * z), dz + s * (-ry * x + rx * y + z)
        # Bowring's step, good to far below a millimetre near the ground
        p, b = m.sqrt(x * x + y * y), there.a * (1 - there.flat)
        u = m.atan2(z * there.a, p * b)
        phi = m.atan2(z + there.e2 / (1 - there.e2) * b * m.sin(u) * m.sin(u) * m.sin(u), p - there.e2 * there.a * m.cos(u) * m.cos(u) * m.cos(u))
        return m.degrees(m.atan2(y, x)), m.degrees(phi)


def projected(x: Column, y: Column, definition: int | str, inverse: bool = False) -> Column:
    """A struct of x and y in a system, from WGS 84 longitude and latitude, or the other way. Computed on arrays: as column
    expressions the long series of some systems take their time to plan."""
    own = system(definition)

    @F.pandas_udf("x double, y double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            u, v = (own.inverse if inverse else own.forward)(a.to_numpy(float), b.to_numpy(float), ARRAYS)
        return pd.DataFrame({"x": u, "y": v})

    return run(x, y)


@lru_cache(256)
def system(definition: int | str) -> Crs:
    """The system of an EPSG code (a number or EPSG:number), a PROJ string or a WKT string."""
    text = str(definition).strip()
    if m := re.fullmatch(r"(?:EPSG:+)?(\d+)", text, re.I):
        return of_proj(proj_of(int(m[1])))
    if "+proj=" in text:
        return of_proj(text)
    if re.match(r"(PROJCS|GEOGCS)\s*\[", text, re.I):
        return of_wkt(text)
    raise ValueError(f"no coordinate system {definition!r}")


def proj_of(code: int) -> str:
    """The definition of a code: one of a numbered series, or of CODES."""
    utm = {326: "WGS84", 327: "WGS84", 258: "GRS80", 269: "GRS80"}
    if code // 100 in utm and 1 <= code % 100 <= 60:
        return f"+proj=utm +zone={code % 100} +ellps={utm[code // 100]}" + (" +south" if code // 100 == 327 else "")
    if 4513 <= code <= 4533:  # three-degree zones with their number before the easting
        return f"+proj=tmerc +lon_0={75 + 3 * (code - 4513)} +x_0={25 + code - 4513}500000 +ellps=GRS80"
    if 4534 <= code <= 4554:
        return f"+proj=tmerc +lon_0={75 + 3 * (code - 4534)} +x_0=500000 +ellps=GRS80"
    if code not in CODES:
        raise ValueError(f"no coordinate system EPSG:{code}")
    return CODES[code]


def of_proj(text: str) -> Crs:
    given = {k: v or "" for k, v in re.findall(r"\+(\w+)(?:=(\S+))?", text)}
    number = lambda k, d=None: float(given[k]) if k in given else d
    kind = given["proj"].replace("latlong", "longlat")
    ellipsoid = given.get("ellps") or DATUMS.get(given.get("datum", ""), "WGS84")
    if ellipsoid not in ELLIPSOIDS:
        raise ValueError(f"no ellipsoid {ellipsoid!r}")
    a, inverse = ELLIPSOIDS[ellipsoid]
    a = number("R", number("a", a))
    if "b" in given or "rf" in given:
        inverse = number("rf") or (a / (a - number("b")) if a != number("b") else 0.0)
    if "R" in given:
        inverse = 0.0
    unit = number("to_meter", {"us-ft": 1200 / 3937, "ft": 0.3048}.get(given.get("units", "m"), 1.0))
    shift = tuple(float(v) for v in given["towgs84"].split(",")) if given.get("towgs84") else ()
    own = Crs(kind, a, 1 / inverse if inverse else 0.0, number("lon_0", 0.0), number("lat_0", 0.0), number("lat_1", 0.0), number("lat_2"), number("lat_ts"), number("k", number("k_0", 1.0)), number("x_0", 0.0), number("y_0", 0.0), unit, shift)
    if kind == "utm":
        own = replace(own, kind="tmerc", lon0=6 * number("zone") - 183, k=0.9996, x0=500000.0, y0=10000000.0 if "south" in given else 0.0)
    if kind == "lcc" and "lat_1" not in given:
        own = replace(own, lat1=own.lat0)
    if own.kind == "stere" and abs(own.lat0) != 90:
        raise ValueError("only polar stereographic systems")
    if own.kind not in ("longlat", "webmerc", "merc", "tmerc", "lcc", "aea", "stere"):
        raise ValueError(f"no projection {kind!r}")
    return own


# Names in WKT of projections and of their parameters
NAMES = {
    "transverse_mercator": "tmerc", "gauss_kruger": "tmerc", "mercator_1sp": "merc", "mercator_2sp": "merc", "mercator": "merc", "mercator_auxiliary_sphere": "webmerc", "lambert_conformal_conic": "lcc",
    "lambert_conformal_conic_1sp": "lcc", "lambert_conformal_conic_2sp": "lcc", "albers": "aea", "albers_conic_equal_area": "aea", "polar_stereographic": "stere", "stereographic_north_pole": "stere", "stereographic_south_pole": "stere",
}
PARAMETERS = {
    "central_meridian": "lon0", "longitude_of_center": "lon0", "straight_vertical_longitude_from_pole": "lon0", "latitude_of_origin": "lat0", "latitude_of_center": "lat0", "standard_parallel_1": "lat1",
    "standard_parallel_2": "lat2", "scale_factor": "k", "false_easting": "x0", "false_northing": "y0",
}


def nodes(text: str) -> list:
    """A WKT text as [name, item, ...], items being strings, numbers or such lists."""
    tokens, at = re.findall(r'"[^"]*"|[\[\](),]|[^\s\[\](),"]+', text), 0

    def node() -> list:
        nonlocal at
        out, at = [tokens[at].upper()], at + 2
        while tokens[at] not in "])":
            t = tokens[at]
            if t == ",":
                at += 1
            elif at + 1 < len(tokens) and tokens[at + 1] in "[(":
                out.append(node())
            else:
                out.append(t.strip('"') if t[0] == '"' or not re.match(r"[-+.\d]", t) else float(t))
                at += 1
        at += 1
        return out

    return node()


def of_wkt(text: str) -> Crs:
    tree = nodes(text)
    found: dict[str, list[list]] = {}

    def walk(n: list) -> None:
        found.setdefault(n[0], []).append(n[1:])
        for x in n:
            if isinstance(x, list):
                walk(x)

    walk(tree)
    _, a, inverse, *_ = found["SPHEROID"][0]
    own = Crs("longlat", a, 1 / inverse if inverse else 0.0, shift=tuple(found["TOWGS84"][0]) if "TOWGS84" in found else ())
    if tree[0] == "GEOGCS":
        return own
    name = found["PROJECTION"][0][0].lower()
    if name not in NAMES:
        raise ValueError(f"no projection {name!r}")
    unit = next((x[2] for x in tree if isinstance(x, list) and x[0] == "UNIT"), 1.0)
    given = {p.lower(): v for p, v in found.get("PARAMETER", [])}
    values = {PARAMETERS[p]: v * unit if p.startswith("false") else v for p, v in given.items() if p in PARAMETERS}
    own = replace(own, kind=NAMES[name], unit=unit, **values)
    if own.kind == "lcc" and "lat1" not in values:
        own = replace(own, lat1=own.lat0)
    if own.kind == "merc" and values.get("lat1"):
        own = replace(own, ts=own.lat1)
    if own.kind == "stere":
        at = values.get("lat0", values.get("lat1", -90.0 if "south" in name else 90.0))
        own = replace(own, lat0=math.copysign(90.0, at), ts=None if abs(at) == 90 else at)
    return own
