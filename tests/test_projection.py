"""Coordinate systems against published points, closed forms and each other."""

import math

import numpy as np
import pytest
import snyder
from pyspark.sql import functions as F

from rasterloom.functions import projection
from rasterloom.functions.projection import ARRAYS, system

#: Worked examples of the literature: definition, longitude, latitude, x, y, tolerance in metres.
KNOWN = [
    # Snyder 1987: transverse Mercator (p. 269), Lambert (p. 296), Albers (p. 292), polar stereographic (p. 314)
    ("+proj=utm +zone=18 +ellps=clrk66", -73.5, 40.5, 627106.5, 4484124.4, 0.1),
    ("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75, 35, 1894410.9, 1564649.5, 0.1),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75, 35, 1885472.7, 1535925.0, 0.1),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=-100 +ellps=intl", 150, -75, -1540033.6, -560526.4, 0.1),
    ("EPSG:3857", -100.33333333, 24.46358, -11169055.58, 2810000.0, 60),
    # the national grid's worked example (Ordnance Survey, guide to coordinate systems), on its own datum
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 1.717921583, 52.657570250, 651409.903, 313177.270, 0.05),
]


@pytest.mark.parametrize("definition, lon, lat, x, y, near", KNOWN)
def test_known_points(definition, lon, lat, x, y, near):
    got = system(definition).forward(lon, lat, ARRAYS)
    assert got == pytest.approx((x, y), abs=near)


EVERY = [4326, 3857, 3395, 32649, 32733, 25832, 4547, 4525, 3413, 3031, 5070, 2154, 27700, "+proj=lcc +lat_1=-33 +lat_0=-33 +lon_0=20 +k=0.999 +ellps=intl +towgs84=-87,-98,-121", "+proj=aea +lat_1=-18 +lat_2=-36 +lon_0=132 +ellps=GRS80"]


@pytest.mark.parametrize("definition", EVERY)
def test_round_trip(spark, definition):
    own = system(definition)
    rng = np.random.default_rng(4)
    south = own.lat0 < 0 or own.lat1 < 0
    lat = -rng.uniform(50, 85, 50) if own.kind == "stere" and south else rng.uniform(50, 85, 50) if own.kind == "stere" else rng.uniform(-60, -20, 50) if south else rng.uniform(20, 60, 50)
    lon = own.lon0 + rng.uniform(-3, 3, 50)
    x, y = own.forward(lon, lat, ARRAYS)
    back = own.inverse(x, y, ARRAYS)
    # a shift of seven parameters is turned back by its signs, which is right to about a centimetre
    near = 3e-7 if any(own.shift) else 1e-9 if own.kind != "aea" else 1e-7
    assert np.abs(back[0] - lon).max() < near and np.abs(back[1] - lat).max() < near
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    cx, cy = own.forward(F.col("lon"), F.col("lat"))
    got = rows.select(cx.alias("x"), cy.alias("y")).collect()
    assert np.allclose([r.x for r in got], x, rtol=0, atol=1e-6) and np.allclose([r.y for r in got], y, rtol=0, atol=1e-6)


def test_datum_shift():
    """The tower of Caister's published coordinates on both datums differ by what seven parameters give, to a few metres."""
    x, y = system(27700).forward(1.716073973, 52.658007833, ARRAYS)
    assert (x, y) == pytest.approx((651409.9, 313177.3), abs=6)


def test_series_agree(spark):
    """Within a zone both series for the transverse Mercator differ by less than a millimetre."""
    rows = spark.createDataFrame([(108.0 + i / 10, 1.0 * j) for i in range(60) for j in range(-80, 81, 20)], "lon double, lat double")
    (a, b), (c, d) = snyder.to_utm(F.col("lon"), F.col("lat"), 49), system(32649).forward(F.col("lon"), F.col("lat"))
    off = rows.select(F.max(F.abs(a - c)), F.max(F.abs(b - d))).first()
    assert max(off) < 5e-3


def test_wkt():
    text = """PROJCS["WGS 84 / UTM zone 49N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563,AUTHORITY["EPSG","7030"]]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],
      PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",111],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AXIS["Easting",EAST]]"""
    assert system(text) == system(32649)
    albers = 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["GRS 1980",6378137,298.257222101],TOWGS84[0,0,0]]],PROJECTION["Albers_Conic_Equal_Area"],PARAMETER["standard_parallel_1",29.5],PARAMETER["standard_parallel_2",45.5],PARAMETER["latitude_of_center",23],PARAMETER["longitude_of_center",-96],PARAMETER["false_easting",0],PARAMETER["false_northing",0],UNIT["foot",0.3048]]'
    x, y = system(albers).forward(-75.0, 35.0, ARRAYS)
    assert (x * 0.3048, y * 0.3048) == pytest.approx(system(5070).forward(-75.0, 35.0, ARRAYS), abs=1e-6)
    polar = 'PROJCS["p",GEOGCS["g",DATUM["d",SPHEROID["WGS 84",6378137,298.257223563]]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",70],PARAMETER["central_meridian",-45],UNIT["metre",1]]'
    assert system(polar).forward(10.0, 80.0, ARRAYS) == pytest.approx(system(3413).forward(10.0, 80.0, ARRAYS))
    assert system('GEOGCS["g",DATUM["d",SPHEROID["s",6378137,298.257223563]]]').kind == "longlat"


@pytest.mark.parametrize("bad", [9, "EPSG:1", "+proj=robin", "+proj=stere +lat_0=40", "+proj=longlat +ellps=none", "UTM 49", 'PROJCS["x",GEOGCS["g",DATUM["d",SPHEROID["s",1,0]]],PROJECTION["Krovak"]]'])
def test_refused(bad):
    with pytest.raises(ValueError):
        system(bad)


def test_unit_lengths():
    """A quarter meridian and a degree on the equator."""
    x, _ = system("+proj=tmerc +ellps=WGS84").forward(0.0, 0.0, ARRAYS)
    _, y = system("+proj=tmerc +ellps=WGS84").forward(0.0, 90.0 - 1e-9, ARRAYS)
    assert x == 0 and y == pytest.approx(10001965.729, abs=0.01)
    assert projection.Crs("merc").forward(1.0, 0.0, ARRAYS)[0] == pytest.approx(math.radians(1) * 6378137)
