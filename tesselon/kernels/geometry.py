"""Planar geometry values and their WKB and WKT forms.

A value is ``Geom(kind, data, z)``.  ``data`` is a coordinate tuple or None (point), a list of
coordinates (line), a list of rings (polygon), or a list of ``Geom`` (multi-part).  WKB is written
little-endian with ISO type codes; big-endian, EWKB flags and hex text are read as well.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}
KINDS = {v.upper(): k for k, v in NAMES.items()} | {"LINEARRING": LINE}
PART = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}


@dataclass(frozen=True, eq=True)
class Geom:
    kind: int
    data: object
    z: bool = False

    @property
    def name(self) -> str:
        return NAMES[self.kind]

    @property
    def is_empty(self) -> bool:
        if self.kind == POINT:
            return self.data is None
        if self.kind <= POLYGON:
            return not self.data or (self.kind == POLYGON and not self.data[0])
        return all(g.is_empty for g in self.data)

    def parts(self) -> list[Geom]:
        """Its simple geometries, collections unpacked; empty ones left out."""
        if self.kind <= POLYGON:
            return [] if self.is_empty else [self]
        return [p for g in self.data for p in g.parts()]

    def coords(self) -> list[tuple]:
        if self.kind == POINT:
            return [] if self.data is None else [self.data]
        if self.kind == LINE:
            return list(self.data)
        if self.kind == POLYGON:
            return [c for r in self.data for c in r]
        return [c for g in self.data for c in g.coords()]

    def bounds(self) -> tuple[float, float, float, float] | None:
        c = self.coords()
        if not c:
            return None
        xs, ys = [p[0] for p in c], [p[1] for p in c]
        return min(xs), min(ys), max(xs), max(ys)

    def dimension(self) -> int:
        """Of its highest part; -1 if empty."""
        return max((p.kind - 1 for p in self.parts()), default=-1)

    def map(self, f) -> Geom:
        """The geometry with ``f`` applied to every coordinate."""
        if self.kind == POINT:
            return self if self.data is None else Geom(POINT, f(self.data), self.z)
        if self.kind == LINE:
            return Geom(LINE, [f(c) for c in self.data], self.z)
        if self.kind == POLYGON:
            return Geom(POLYGON, [[f(c) for c in r] for r in self.data], self.z)
        return Geom(self.kind, [g.map(f) for g in self.data], self.z)


def point(x, y, z=None) -> Geom:
    return Geom(POINT, (float(x), float(y)) if z is None else (float(x), float(y), float(z)), z is not None)


def line(coords) -> Geom:
    return Geom(LINE, [tuple(map(float, c)) for c in coords])


def polygon(shell, holes=()) -> Geom:
    close = lambda r: r if r and r[0] == r[-1] else [*r, *r[:1]]
    return Geom(POLYGON, [close([tuple(map(float, c)) for c in r]) for r in (shell, *holes)])


def box(xmin, ymin, xmax, ymax) -> Geom:
    return polygon([(xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)])


EMPTY = Geom(COLLECTION, [])


def collect(parts: list[Geom]) -> Geom:
    """The simplest geometry that holds the parts."""
    if not parts:
        return EMPTY
    if len(parts) == 1:
        return parts[0]
    kinds = {p.kind for p in parts}
    return Geom(kinds.pop() + 3 if len(kinds) == 1 and max(kinds | {0}) <= POLYGON else COLLECTION, parts, any(p.z for p in parts))


# WKB

def to_wkb(g: Geom) -> bytes:
    out = bytearray()
    _write(g, out)
    return bytes(out)


def _write(g: Geom, out: bytearray) -> None:
    out += struct.pack("<BI", 1, g.kind + (1000 if g.z else 0))
    dim = 3 if g.z else 2
    if g.kind == POINT:
        out += struct.pack(f"<{dim}d", *(g.data if g.data is not None else (math.nan,) * dim))
    elif g.kind in (LINE, POLYGON):
        rings = [g.data] if g.kind == LINE else g.data
        if g.kind == POLYGON:
            out += struct.pack("<I", len(rings))
        for r in rings:
            flat = [v for c in r for v in c]
            out += struct.pack(f"<I{len(flat)}d", len(r), *flat)
    else:
        out += struct.pack("<I", len(g.data))
        for p in g.data:
            _write(p, out)


def from_wkb(b) -> Geom:
    if isinstance(b, str):
        b = bytes.fromhex(b)
    g, at = _read(memoryview(b), 0)
    if at != len(b):
        raise ValueError("WKB has bytes after its geometry")
    return g


def _read(b, at: int) -> tuple[Geom, int]:
    if len(b) < at + 5:
        raise ValueError("WKB ends early")
    e = "<" if b[at] else ">"
    (code,) = struct.unpack_from(e + "I", b, at + 1)
    at += 5
    flags, code = code & 0xE0000000, code & 0x1FFFFFFF
    if flags & 0x20000000:
        at += 4
    kind, level = code % 1000, code // 1000
    z, m = bool(flags & 0x80000000) or level in (1, 3), bool(flags & 0x40000000) or level in (2, 3)
    if kind not in NAMES:
        raise ValueError(f"unknown WKB type {code}")
    dim, keep = 2 + z + m, 2 + z

    def number():
        nonlocal at
        if len(b) < at + 4:
            raise ValueError("WKB ends early")
        (n,) = struct.unpack_from(e + "I", b, at)
        at += 4
        return n

    def path(n):
        nonlocal at
        if len(b) < at + 8 * dim * n:
            raise ValueError("WKB ends early")
        v = struct.unpack_from(f"{e}{dim * n}d", b, at)
        at += 8 * dim * n
        return [v[i : i + keep] for i in range(0, dim * n, dim)]

    if kind == POINT:
        (c,) = path(1)
        return Geom(POINT, None if c[0] != c[0] else c, z), at
    if kind == LINE:
        return Geom(LINE, path(number()), z), at
    if kind == POLYGON:
        return Geom(POLYGON, [path(number()) for _ in range(number())], z), at
    parts = []
    for _ in range(number()):
        p, at = _read(b, at)
        parts.append(p)
    return Geom(kind, parts, z), at


# WKT

def _number(v: float, precision: int, trim: bool) -> str:
    if precision >= 0:
        s = f"{v:.{precision}f}"
        if trim and "." in s:
            s = s.rstrip("0").rstrip(".")
        return "0" if s == "-0" else s
    return str(int(v)) if trim and v == int(v) and abs(v) < 1e16 else repr(v)


def to_wkt(g: Geom, rounding_precision: int = 6, trim: bool = True) -> str:
    num = lambda c: " ".join(_number(v, rounding_precision, trim) for v in c)
    path = lambda r: "(" + ", ".join(map(num, r)) + ")"

    def body(g):
        if g.is_empty and (g.kind <= POLYGON or not g.data):
            return "EMPTY"
        if g.kind == POINT:
            return f"({num(g.data)})"
        if g.kind == LINE:
            return path(g.data)
        if g.kind == POLYGON:
            return "(" + ", ".join(map(path, g.data)) + ")"
        if g.kind == COLLECTION:
            return "(" + ", ".join(to_wkt(p, rounding_precision, trim) for p in g.data) + ")"
        return "(" + ", ".join(body(p) for p in g.data) + ")"

    return f"{g.name.upper()}{' Z' if g.z else ''} {body(g)}"


_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+0-9.eE]+|[(),])")


def from_wkt(text: str) -> Geom:
    text = re.sub(r"^\s*SRID=\d+;", "", text)
    tokens, at = _TOKEN.findall(text), 0
    if re.sub(r"\s+", "", text) != "".join(tokens):
        raise ValueError(f"not WKT: {text[:60]!r}")

    def take(want=None):
        nonlocal at
        if at >= len(tokens) or (want and tokens[at].upper() != want):
            raise ValueError(f"not WKT: {text[:60]!r}")
        at += 1
        return tokens[at - 1]

    def peek():
        return tokens[at].upper() if at < len(tokens) else ""

    def coord():
        c = [float(take())]
        while peek() not in (",", ")"):
            c.append(float(take()))
        return tuple(c[: 3 if z else 2]) if len(c) <= 3 or not z else tuple(c[:3])

    def listed(item):
        if peek() == "EMPTY":
            take()
            return []
        take("(")
        out = [item()]
        while peek() == ",":
            take()
            out.append(item())
        take(")")
        return out

    def wrapped():
        if peek() == "(":
            take("(")
            c = coord()
            take(")")
            return c
        return coord()

    def geometry():
        nonlocal z
        word = take().upper()
        has_z = word.endswith("Z") and word[:-1] in KINDS
        kind = KINDS.get(word[:-1] if has_z else word)
        if kind is None:
            raise ValueError(f"unknown WKT type {word!r}")
        while peek() in ("Z", "M", "ZM"):
            has_z |= "Z" in take().upper()
        if not has_z and kind != COLLECTION:
            k = at
            while k < len(tokens) and tokens[k] == "(":
                k += 1
            n = 0
            while k < len(tokens) and tokens[k] not in ("(", ")", ","):
                k, n = k + 1, n + 1
            has_z = n == 3
        z = has_z
        if kind == POINT:
            c = listed(coord)
            return Geom(POINT, c[0] if c else None, has_z)
        if kind == LINE:
            return Geom(LINE, listed(coord), has_z)
        if kind == POLYGON:
            return Geom(POLYGON, listed(lambda: listed(coord)), has_z)
        if kind == MULTIPOINT:
            return Geom(kind, [Geom(POINT, c, has_z) for c in listed(wrapped)], has_z)
        if kind == MULTILINE:
            return Geom(kind, [Geom(LINE, r, has_z) for r in listed(lambda: listed(coord))], has_z)
        if kind == MULTIPOLYGON:
            return Geom(kind, [Geom(POLYGON, r, has_z) for r in listed(lambda: listed(lambda: listed(coord)))], has_z)
        parts = listed(geometry)
        return Geom(kind, parts, any(p.z for p in parts))

    z = False
    g = geometry()
    if at != len(tokens):
        raise ValueError(f"not WKT: {text[:60]!r}")
    return g


def as_geom(v) -> Geom | None:
    """A geometry from WKB, hex or WKT text, a mapping or anything with ``__geo_interface__``."""
    if v is None or isinstance(v, Geom):
        return v
    if isinstance(v, (bytes, bytearray, memoryview)):
        return from_wkb(bytes(v))
    if isinstance(v, str):
        return from_wkb(v) if re.fullmatch(r"(?:[0-9A-Fa-f]{2}){5,}", v) else from_wkt(v)
    if hasattr(v, "__geo_interface__"):
        v = v.__geo_interface__
    if isinstance(v, dict):
        return from_mapping(v)
    raise TypeError(f"cannot read a geometry from {type(v).__name__}")


def from_mapping(m: dict) -> Geom:
    """From a GeoJSON-like mapping."""
    kind = KINDS[m["type"].upper()]
    if kind == COLLECTION:
        parts = [from_mapping(p) for p in m["geometries"]]
        return Geom(kind, parts, any(p.z for p in parts))
    c = m.get("coordinates") or []
    t = lambda p: tuple(map(float, p[:3]))
    path = lambda r: [t(p) for p in r]
    if kind == POINT:
        return Geom(POINT, t(c) if c else None, len(c) > 2)
    if kind == LINE:
        return Geom(LINE, path(c), bool(c) and len(c[0]) > 2)
    if kind == POLYGON:
        return Geom(POLYGON, [path(r) for r in c], bool(c) and len(c[0][0]) > 2)
    parts = [from_mapping({"type": NAMES[PART[kind]], "coordinates": p}) for p in c]
    return Geom(kind, parts, any(p.z for p in parts))


def to_mapping(g: Geom) -> dict:
    if g.kind == COLLECTION:
        return {"type": g.name, "geometries": [to_mapping(p) for p in g.data]}
    if g.kind == POINT:
        c = list(g.data or ())
    elif g.kind == LINE:
        c = [list(p) for p in g.data]
    elif g.kind == POLYGON:
        c = [[list(p) for p in r] for r in g.data]
    else:
        c = [to_mapping(p)["coordinates"] for p in g.data]
    return {"type": g.name, "coordinates": c}
