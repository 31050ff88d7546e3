import math
import random

import pytest

from tesselon.functions import crs


def metres(lon, lat, along):
    """Length of a degree along the meridian or the parallel, on the ellipsoid."""
    e2 = crs._ECC**2
    w = 1 - e2 * math.sin(math.radians(lat)) ** 2
    return math.radians(1) * crs.RADIUS * (math.cos(math.radians(lat)) / math.sqrt(w) if along == "lon" else (1 - e2) / w**1.5)


def test_a_published_example():
    x, y = crs.transformer(4258, 3035)(5.0, 50.0)
    assert abs(x - 3962799.45) < 0.01 and abs(y - 2999718.85) < 0.01


@pytest.mark.parametrize("code", [*crs.CONIC, "EPSG:3395", "EPSG:3857", "EPSG:32633", "EPSG:25832", "EPSG:26918", "EPSG:32733"])
def test_there_and_back(code):
    rnd = random.Random(1)
    lon0 = crs.CONIC[code][2] if code in crs.CONIC else {"EPSG:32633": 15, "EPSG:25832": 9, "EPSG:26918": -75, "EPSG:32733": 15}.get(code, 0)
    lat0 = crs.CONIC[code][1] if code in crs.CONIC else 0
    there, back = crs.transformer(4326, code), crs.transformer(code, 4326)
    for _ in range(200):
        lon, lat = lon0 + rnd.uniform(-5, 5), max(-80, min(80, lat0 + rnd.uniform(-25, 25)))
        a, b = back(*there(lon, lat))
        assert abs(a - lon) < 1e-9 and abs(b - lat) < 1e-9


def jacobian(code, lon, lat, h=1e-5):
    f = crs.transformer(4326, code)
    (ax, ay), (bx, by) = f(lon - h, lat), f(lon + h, lat)
    (cx, cy), (dx, dy) = f(lon, lat - h), f(lon, lat + h)
    k = 2 * h
    east = ((bx - ax) / k / metres(lon, lat, "lon"), (by - ay) / k / metres(lon, lat, "lon"))
    return east, ((dx - cx) / k / metres(lon, lat, "lat"), (dy - cy) / k / metres(lon, lat, "lat"))


@pytest.mark.parametrize("code", list(crs.CONIC))
def test_what_each_projection_keeps(code):
    kind, lat0, lon0, lat1, lat2, *_ = crs.CONIC[code]
    for lon, lat in ((lon0 + 4, lat0 + 3), (lon0 - 7, lat0 - 5)):
        (ax, ay), (bx, by) = jacobian(code, lon, lat)
        if kind == "lcc":  # angles
            assert abs(ax * bx + ay * by) < 1e-6 and abs(math.hypot(ax, ay) - math.hypot(bx, by)) < 1e-6
        else:  # areas
            assert abs(abs(ax * by - ay * bx) - 1) < 1e-6
    if kind != "laea":  # scale along the standard parallels
        for lat in (lat1, lat2):
            assert abs(math.hypot(*jacobian(code, lon0 + 2, lat)[0]) - 1) < 1e-6
    origin = crs.transformer(4326, code)(lon0, lat0)
    assert math.dist(origin, crs.CONIC[code][5:]) < 1e-6


def test_an_unknown_system_raises_without_a_library():
    pytest.importorskip("pyspark")
    try:
        import pyproj  # noqa: F401
    except ImportError:
        with pytest.raises(ValueError):
            crs.transformer(4326, 27700)
