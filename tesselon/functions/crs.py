"""Coordinate reference systems: labels, and closed-form transformations.

Geographic WGS 84, NAD 83 and ETRS 89 (EPSG:4326, OGC:CRS84, 4269, 4258), spherical and ellipsoidal Mercator
(EPSG:3857, 3395), the UTM zones on WGS 84, NAD 83 and ETRS 89 (EPSG:326xx, 327xx, 269xx, 258xx) and the
conic and azimuthal systems in ``CONIC`` are computed here, datums taken as one; axis order is x = east, y = north.
Other pairs go through ``pyproj`` where it can be imported, else they raise ``ValueError``.
"""

from __future__ import annotations

import math
import re

from tesselon.kernels.geometry import Geom

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563


def name_of(crs) -> str | None:
    """A canonical label: AUTHORITY:CODE where one can be read, else the text itself."""
    if crs is None:
        return None
    if isinstance(crs, int):
        return f"EPSG:{crs}"
    if isinstance(crs, dict):
        i = crs.get("id") or {}
        return name_of(f"{i['authority']}:{i['code']}") if "code" in i else str(crs.get("name"))
    m = re.fullmatch(r"\s*(?:urn:ogc:def:crs:)?([A-Za-z]+):+(?:[\d.]*:)?(\w+)\s*", str(crs))
    return f"{m[1].upper()}:{m[2].upper()}" if m else str(crs)


def same(a, b) -> bool:
    plain = lambda c: {"OGC:CRS84": "EPSG:4326"}.get(name_of(c), name_of(c))
    return plain(a) == plain(b)


def _utm(code: str):
    m = re.fullmatch(r"EPSG:(326|327|269|258)(\d\d)", code)
    return (int(m[2]), m[1] == "327") if m and 1 <= int(m[2]) <= 60 else None


def _series():
    n = FLATTENING / (2 - FLATTENING)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    be = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return a, al, be


_A, _ALPHA, _BETA = _series()
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))


def _to_utm(lon, lat, zone, south):
    lam, phi = math.radians(lon - (zone * 6 - 183)), math.radians(lat)
    t = math.sinh(math.atanh(math.sin(phi)) - _ECC * math.atanh(_ECC * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return 500000 + 0.9996 * _A * x, (10000000 if south else 0) + 0.9996 * _A * y


def _from_utm(x, y, zone, south):
    xi, eta = (y - (10000000 if south else 0)) / (0.9996 * _A), (x - 500000) / (0.9996 * _A)
    p = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    q = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = math.asin(math.sin(p) / math.cosh(q))
    goal, phi = math.atanh(math.sin(chi)), chi
    for _ in range(8):
        phi = math.asin(math.tanh(goal + _ECC * math.atanh(_ECC * math.sin(phi))))
    return math.degrees(math.atan2(math.sinh(q), math.cos(p))) + zone * 6 - 183, math.degrees(phi)


# Projection, latitude and longitude of the origin, standard parallels, false easting and northing.
CONIC = {
    "EPSG:2154": ("lcc", 46.5, 3.0, 49.0, 44.0, 700_000.0, 6_600_000.0),
    "EPSG:3034": ("lcc", 52.0, 10.0, 35.0, 65.0, 4_000_000.0, 2_800_000.0),
    "EPSG:3035": ("laea", 52.0, 10.0, 0.0, 0.0, 4_321_000.0, 3_210_000.0),
    "EPSG:3347": ("lcc", 63.390675, -91.86666666666666, 49.0, 77.0, 6_200_000.0, 3_000_000.0),
    "EPSG:3577": ("albers", 0.0, 132.0, -18.0, -36.0, 0.0, 0.0),
    "EPSG:5070": ("albers", 23.0, -96.0, 29.5, 45.5, 0.0, 0.0),
}


def _m(phi):
    return math.cos(phi) / math.sqrt(1 - (_ECC * math.sin(phi)) ** 2)


def _t(phi):
    """Of the isometric latitude psi: exp(-psi)."""
    return math.exp(_ECC * math.atanh(_ECC * math.sin(phi)) - math.asinh(math.tan(phi)))


def _from_t(t):
    goal, phi = -math.log(t), math.pi / 2 - 2 * math.atan(t)
    for _ in range(8):
        phi = math.atan(math.sinh(goal + _ECC * math.atanh(_ECC * math.sin(phi))))
    return phi


def _q(phi):
    """Twice the area of the ellipsoid's zone from the equator, per radian, with a semi-major axis of 1."""
    s = math.sin(phi)
    return (1 - _ECC**2) * (s / (1 - (_ECC * s) ** 2) + math.atanh(_ECC * s) / _ECC)


def _from_q(q):
    if abs(q) >= _q(math.pi / 2):
        return math.copysign(math.pi / 2, q)
    phi = math.asin(q / 2)
    for _ in range(8):
        s = math.sin(phi)
        phi += (1 - (_ECC * s) ** 2) ** 2 / (2 * math.cos(phi)) * (q - _q(phi)) / (1 - _ECC**2)
    return phi


def _conic(kind, lat0, lon0, lat1, lat2, east, north):
    """(to degrees, from degrees) of a conic or azimuthal system."""
    p0, p1, p2, l0 = (math.radians(v) for v in (lat0, lat1, lat2, lon0))
    turn = lambda d: math.remainder(d, 2 * math.pi)
    if kind == "laea":
        qp, q0 = _q(math.pi / 2), _q(p0)
        b0 = math.asin(q0 / qp)
        r = RADIUS * math.sqrt(qp / 2)
        d = RADIUS * _m(p0) / (r * math.cos(b0))

        def back(x, y):
            x, y = (x - east) / d, (y - north) * d
            rho = math.hypot(x, y)
            if rho == 0:
                return lon0, lat0
            c = 2 * math.asin(min(1.0, rho / (2 * r)))
            q = qp * (math.cos(c) * math.sin(b0) + y * math.sin(c) * math.cos(b0) / rho)
            lam = math.atan2(x * math.sin(c), rho * math.cos(b0) * math.cos(c) - y * math.sin(b0) * math.sin(c))
            return math.degrees(turn(l0 + lam)), math.degrees(_from_q(q))

        def there(lon, lat):
            b, lam = math.asin(max(-1.0, min(1.0, _q(math.radians(lat)) / qp))), turn(math.radians(lon) - l0)
            k = r * math.sqrt(2 / (1 + math.sin(b0) * math.sin(b) + math.cos(b0) * math.cos(b) * math.cos(lam)))
            return east + k * d * math.cos(b) * math.sin(lam), north + k / d * (math.cos(b0) * math.sin(b) - math.sin(b0) * math.cos(b) * math.cos(lam))

        return back, there
    if kind == "lcc":
        n = (math.log(_m(p1)) - math.log(_m(p2))) / (math.log(_t(p1)) - math.log(_t(p2)))
        f = RADIUS * _m(p1) / (n * _t(p1) ** n)
        radius, latitude = (lambda p: f * _t(p) ** n), (lambda rho: _from_t((rho / f) ** (1 / n)))
    else:
        n = (_m(p1) ** 2 - _m(p2) ** 2) / (_q(p2) - _q(p1))
        c = _m(p1) ** 2 + n * _q(p1)
        radius, latitude = (lambda p: RADIUS * math.sqrt(max(0.0, c - n * _q(p))) / n), (lambda rho: _from_q((c - (rho * n / RADIUS) ** 2) / n))
    r0, sign = radius(p0), math.copysign(1.0, n)

    def back(x, y):
        x, y = x - east, r0 - (y - north)
        rho, theta = sign * math.hypot(x, y), math.atan2(sign * x, sign * y)
        return math.degrees(turn(l0 + theta / n)), math.degrees(latitude(rho))

    def there(lon, lat):
        rho, theta = radius(math.radians(lat)), n * turn(math.radians(lon) - l0)
        return east + rho * math.sin(theta), north + r0 - rho * math.cos(theta)

    return back, there


_KNOWN: dict[str, tuple] = {}


def _degrees(code: str):
    """Functions (to degrees, from degrees) of a known system."""
    if code in ("EPSG:4326", "OGC:CRS84", "EPSG:4269", "EPSG:4258"):
        return (lambda x, y: (x, y)), (lambda x, y: (x, y))
    if code == "EPSG:3857":
        return (
            lambda x, y: (math.degrees(x / RADIUS), math.degrees(2 * math.atan(math.exp(y / RADIUS)) - math.pi / 2)),
            lambda x, y: (math.radians(x) * RADIUS, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * RADIUS),
        )
    if code == "EPSG:3395":
        return (
            lambda x, y: (math.degrees(x / RADIUS), math.degrees(_from_t(math.exp(-y / RADIUS)))),
            lambda x, y: (math.radians(x) * RADIUS, -math.log(_t(math.radians(y))) * RADIUS),
        )
    if code in CONIC:
        if code not in _KNOWN:
            _KNOWN[code] = _conic(*CONIC[code])
        return _KNOWN[code]
    if u := _utm(code):
        return (lambda x, y: _from_utm(x, y, *u)), (lambda x, y: _to_utm(x, y, *u))
    return None


def transformer(source, target):
    """A function on (x, y) from one system to another."""
    a, b = name_of(source), name_of(target)
    if a is None or b is None:
        raise ValueError("a CRS is needed on both sides of a transformation")
    f, g = _degrees(a), _degrees(b)
    if f and g:
        return lambda x, y: g[1](*f[0](x, y))
    try:
        import pyproj
    except ImportError:
        raise ValueError(f"no transformation from {a} to {b} is built in") from None
    t = pyproj.Transformer.from_crs(source, target, always_xy=True)
    return lambda x, y: t.transform(x, y)


def transform(g: Geom, source=None, target=None) -> Geom:
    f = transformer(source, target)
    return g.map(lambda c: (*f(c[0], c[1]), *c[2:]))
