"""Measures and constructions on one geometry."""

from __future__ import annotations

import math

from tesselon.kernels.geometry import COLLECTION, EMPTY, LINE, MULTIPOINT, POINT, POLYGON, Geom, box, collect, line, point, polygon


def ring_area(r) -> float:
    """Signed, positive counter-clockwise; relative to its first vertex to keep precision."""
    if len(r) < 3:
        return 0.0
    x0, y0 = r[0][:2]
    return sum((a[0] - x0) * (b[1] - y0) - (b[0] - x0) * (a[1] - y0) for a, b in zip(r, r[1:])) / 2


def area(g: Geom) -> float:
    return sum(abs(ring_area(p.data[0])) - sum(abs(ring_area(h)) for h in p.data[1:]) for p in g.parts() if p.kind == POLYGON)


def path_length(c) -> float:
    return sum(math.hypot(b[0] - a[0], b[1] - a[1]) for a, b in zip(c, c[1:]))


def length(g: Geom) -> float:
    return sum(path_length(p.data) if p.kind == LINE else sum(map(path_length, p.data)) for p in g.parts() if p.kind != POINT)


def centroid(g: Geom) -> Geom:
    """Weighted by the measure of the highest dimension that has any."""
    parts = g.parts()
    if not parts:
        return Geom(POINT, None)
    ox, oy = parts[0].coords()[0][:2]
    sx = sy = total = 0.0
    for p in parts:
        if p.kind == POLYGON:
            for k, r in enumerate(p.data):
                sign = (1 if k == 0 else -1) * (1 if ring_area(r) >= 0 else -1)
                for a, b in zip(r, r[1:]):
                    ax, ay, bx, by = a[0] - ox, a[1] - oy, b[0] - ox, b[1] - oy
                    c = sign * (ax * by - bx * ay)
                    sx, sy, total = sx + c * (ax + bx) / 3, sy + c * (ay + by) / 3, total + c
    if total == 0:
        sx = sy = 0.0
        for p in parts:
            for r in [] if p.kind == POINT else [p.data] if p.kind == LINE else p.data:
                for a, b in zip(r, r[1:]):
                    d = math.hypot(b[0] - a[0], b[1] - a[1])
                    sx, sy, total = sx + d * ((a[0] + b[0]) / 2 - ox), sy + d * ((a[1] + b[1]) / 2 - oy), total + d
    if total == 0:
        pts = [c for p in parts for c in p.coords()]
        sx, sy, total = sum(c[0] - ox for c in pts), sum(c[1] - oy for c in pts), len(pts)
    return point(ox + sx / total, oy + sy / total)


def orient(a, b, c) -> int:
    """Side of c seen along a->b, exact."""
    l, r = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = l - r
    if abs(d) > 4e-16 * (abs(l) + abs(r)):
        return 1 if d > 0 else -1
    # A difference of equal coordinates is exact, and so is a product with it.
    if (b[0] == a[0] or c[1] == a[1]) and (b[1] == a[1] or c[0] == a[0]):
        return 0
    from fractions import Fraction as Q

    ax, ay, bx, by, cx, cy = (Q(v) for v in (*a[:2], *b[:2], *c[:2]))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def convex_hull(g: Geom) -> Geom:
    pts = sorted({(c[0], c[1]) for c in g.coords()})
    if not pts:
        return EMPTY
    if len(pts) == 1:
        return point(*pts[0])

    def half(points):
        out: list = []
        for p in points:
            while len(out) >= 2 and orient(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    ring = lower[:-1] + upper[:-1]
    return line(ring) if len(ring) == 2 else polygon(ring)


def envelope(g: Geom) -> Geom:
    b = g.bounds()
    if b is None:
        return EMPTY
    if b[0] == b[2] and b[1] == b[3]:
        return point(b[0], b[1])
    if b[0] == b[2] or b[1] == b[3]:
        return line([b[:2], b[2:]])
    return box(*b)


def boundary(g: Geom) -> Geom | None:
    """Rings of areas, end points of lines that an odd number of lines share, nothing for points."""
    if g.kind == COLLECTION:
        return None
    parts = g.parts()
    if g.dimension() == 2:
        return collect([Geom(LINE, r, g.z) for p in parts for r in p.data])
    if g.dimension() == 1:
        n: dict = {}
        for p in parts:
            for c in (p.data[0], p.data[-1]):
                n[c] = n.get(c, 0) + 1
        odd = [Geom(POINT, c, g.z) for c, k in n.items() if k % 2]
        return Geom(MULTIPOINT, odd, g.z) if len(odd) != 1 else odd[0]
    return EMPTY


def exterior(g: Geom) -> Geom | None:
    return Geom(LINE, g.data[0] if g.data else [], g.z) if g.kind == POLYGON else None


def interiors(g: Geom) -> list[Geom] | None:
    return [Geom(LINE, r, g.z) for r in g.data[1:]] if g.kind == POLYGON else None


def representative_point(g: Geom) -> Geom:
    """A point inside: on the widest stretch of a horizontal line for areas, the vertex or point nearest the centroid else."""
    parts = g.parts()
    if not parts:
        return Geom(POINT, None)
    top = g.dimension()
    if top == 2:
        best = (-1.0, 0.0, 0.0)
        for p in parts:
            if p.kind != POLYGON:
                continue
            ys = sorted({c[1] for c in p.coords()})
            mid = (ys[0] + ys[-1]) / 2
            lo, hi = max([y for y in ys if y <= mid]), min([y for y in ys if y > mid], default=ys[-1])
            y = (lo + hi) / 2
            xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in p.data for a, b in zip(r, r[1:]) if (a[1] > y) != (b[1] > y))
            for a, b in zip(xs[::2], xs[1::2]):
                best = max(best, (b - a, (a + b) / 2, y))
        if best[0] > 0:
            return point(*best[1:])
    c = centroid(g).data
    near = lambda pts: min(pts, key=lambda p: math.hypot(p[0] - c[0], p[1] - c[1]))
    if top >= 1:
        inner = [q for p in parts if p.kind == LINE for q in p.data[1:-1]]
        return point(*near(inner or [q for p in parts if p.kind != POINT for q in p.coords()])[:2])
    return point(*near([p.data for p in parts])[:2])


def _peucker(c, tolerance):
    keep = [False] * len(c)
    keep[0] = keep[-1] = True
    stack = [(0, len(c) - 1)]
    while stack:
        i, j = stack.pop()
        worst, at = -1.0, -1
        for k in range(i + 1, j):
            d = segment_distance(c[k], c[i], c[j])
            if d > worst:
                worst, at = d, k
        if worst > tolerance:
            keep[at] = True
            stack += [(i, at), (at, j)]
    return [p for p, k in zip(c, keep) if k]


def simplify(g: Geom, tolerance: float, preserve_topology: bool = True) -> Geom:
    """Douglas-Peucker; with ``preserve_topology`` a result that is not valid is refined until it is."""
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")

    def ring(r):
        out = _peucker(r, tolerance)
        if len(out) >= 4:
            return out
        if not preserve_topology:
            return []
        far = max(range(1, len(r) - 1), key=lambda k: math.hypot(r[k][0] - r[0][0], r[k][1] - r[0][1]))
        side = max((k for k in range(1, len(r) - 1) if k != far), key=lambda k: segment_distance(r[k], r[0], r[far]))
        return [r[0], *(r[k] for k in sorted((far, side))), r[0]]

    def one(p):
        if p.kind == POINT:
            return p
        if p.kind == LINE:
            return Geom(LINE, _peucker(p.data, tolerance), p.z)
        rings = [ring(r) for r in p.data]
        return Geom(POLYGON, [r for r in rings if r] if rings[0] else [], p.z)

    if g.kind <= POLYGON:
        out = g if g.is_empty else one(g)
    else:
        out = Geom(g.kind, [p if p.is_empty else one(p) if p.kind <= POLYGON else simplify(p, tolerance, preserve_topology) for p in g.data], g.z)
        if not preserve_topology:
            out = Geom(g.kind, [p for p in out.data if not p.is_empty], g.z)
    if preserve_topology and g.dimension() == 2:
        from tesselon.kernels.topology import is_valid

        t = tolerance
        while t > tolerance / 1e6 and not is_valid(out):
            t /= 2
            out = simplify(g, t, False)
        if not is_valid(out):
            out = g
    return out


def segment_distance(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _one_line(g: Geom) -> list:
    lines = [p for p in g.parts() if p.kind == LINE]
    if not lines or len(lines) != len(g.parts()):
        raise TypeError("a line is needed")
    return [c for p in lines for c in zip(p.data, p.data[1:])]


def interpolate(g: Geom, distance: float, normalized: bool = False) -> Geom:
    """The point at a distance along a line; negative from its end, beyond the ends clamped."""
    segments = _one_line(g)
    total = length(g)
    d = distance * total if normalized else distance
    if d < 0:
        d = max(0.0, total + d)
    for a, b in segments:
        step = math.hypot(b[0] - a[0], b[1] - a[1])
        if d <= step and step > 0:
            return point(*(u + (v - u) * d / step for u, v in zip(a, b)))
        d -= step
    return point(*segments[-1][1])


def project(g: Geom, other: Geom, normalized: bool = False) -> float:
    """Distance along a line of its point nearest to another point."""
    p = other.data
    best, at, run = math.inf, 0.0, 0.0
    for a, b in _one_line(g):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
        d, step = math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy), math.sqrt(n)
        if d < best:
            best, at = d, run + t * step
        run += step
    return at / run if normalized and run else at


# Affine maps

def affine(g: Geom, matrix) -> Geom:
    """6 numbers a, b, d, e, xoff, yoff or 12 for three dimensions."""
    if len(matrix) == 6:
        a, b, d, e, x0, y0 = matrix
        return g.map(lambda c: (a * c[0] + b * c[1] + x0, d * c[0] + e * c[1] + y0, *c[2:]))
    if len(matrix) != 12:
        raise ValueError("the matrix needs 6 or 12 numbers")
    a, b, c_, d, e, f, h, i, j, x0, y0, z0 = matrix

    def move(c):
        x, y, z = (*c, 0.0)[:3]
        out = (a * x + b * y + c_ * z + x0, d * x + e * y + f * z + y0, h * x + i * y + j * z + z0)
        return out if len(c) > 2 else out[:2]

    return g.map(move)


def origin_of(g: Geom, origin) -> tuple[float, float, float]:
    if isinstance(origin, str):
        if origin == "center":
            b = g.bounds()
            return (0.0, 0.0, 0.0) if b is None else ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, 0.0)
        if origin == "centroid":
            return (*(centroid(g).data or (0.0, 0.0)), 0.0)
        raise ValueError(f"unknown origin {origin!r}")
    c = origin.data if isinstance(origin, Geom) else tuple(origin)
    return (*map(float, c), 0.0)[:3]


def translate(g: Geom, xoff=0.0, yoff=0.0, zoff=0.0) -> Geom:
    return g.map(lambda c: (c[0] + xoff, c[1] + yoff, *(v + zoff for v in c[2:])))


def rotate(g: Geom, angle: float, origin="center", use_radians: bool = False) -> Geom:
    t = angle if use_radians else math.radians(angle)
    s, c = math.sin(t), math.cos(t)
    s, c = (0.0 if abs(v) < 2.5e-16 else v for v in (s, c))
    x, y, _ = origin_of(g, origin)
    return affine(g, (c, -s, s, c, x - x * c + y * s, y - x * s - y * c))


def scale(g: Geom, xfact=1.0, yfact=1.0, zfact=1.0, origin="center") -> Geom:
    x, y, z = origin_of(g, origin)
    return g.map(lambda c: (x + (c[0] - x) * xfact, y + (c[1] - y) * yfact, *(z + (v - z) * zfact for v in c[2:])))


def skew(g: Geom, xs=0.0, ys=0.0, origin="center", use_radians: bool = False) -> Geom:
    if not use_radians:
        xs, ys = math.radians(xs), math.radians(ys)
    tx, ty = math.tan(xs), math.tan(ys)
    tx, ty = (0.0 if abs(v) < 2.5e-16 else v for v in (tx, ty))
    x, y, _ = origin_of(g, origin)
    return affine(g, (1.0, tx, ty, 1.0, -y * tx, -x * ty))
