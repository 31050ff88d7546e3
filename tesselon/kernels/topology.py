"""Relations and overlays from one noded arrangement of edges.

All edges of the inputs are split where they meet.  Each sub-edge then lies in, on or off every input
as a whole: its own sides are known from ring orientation, all other inputs are located once at its
midpoint, which no other edge passes through.  DE-9IM matrices, overlays, many-way unions and validity
are read off the sub-edges, their two sides, and the nodes.  Side tests are exact; crossing points are
rounded to doubles.
"""

from __future__ import annotations

import math
from collections import defaultdict

from tesselon.kernels.geometry import COLLECTION, EMPTY, LINE, MULTILINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, Geom, collect
from tesselon.kernels.measures import orient, ring_area, segment_distance

I, B, E = 0, 1, 2


def _xy(c) -> tuple[float, float]:
    # Adding zero makes -0.0 and 0.0 one vertex.
    return c[0] + 0.0, c[1] + 0.0


def _snap(c, grid):
    return round(c[0] / grid) * grid + 0.0, round(c[1] / grid) * grid + 0.0


def _between(p, a, b) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


class Member:
    """One input: oriented area edges (interior on the left), line edges, points."""

    def __init__(self, g: Geom | None, grid: float = 0.0):
        self.rings, self.lines, self.points = [], [], set()
        if grid and g is not None:
            g = g.map(lambda c: _snap(c, grid))
        for p in g.parts() if g is not None else ():
            if p.kind == POINT:
                self.points.add(_xy(p.data))
            elif p.kind == LINE:
                c = [_xy(c) for c in p.data]
                if len(set(c)) == 1:
                    self.points.add(c[0])
                else:
                    self.lines.append(c)
            else:
                for k, r in enumerate(p.data):
                    c = [_xy(c) for c in r]
                    if len(c) >= 4:
                        self.rings.append(c if (ring_area(c) > 0) == (k == 0) else c[::-1])
        self.area_edges = [(a, b) for r in self.rings for a, b in zip(r, r[1:]) if a != b]
        self.line_edges = [(a, b) for r in self.lines for a, b in zip(r, r[1:]) if a != b]
        ends: dict = defaultdict(int)
        for c in self.lines:
            ends[c[0]] += 1
            ends[c[-1]] += 1
        self.ends = {p for p, n in ends.items() if n % 2}
        xs = [p for e in self.area_edges for p in e]
        self.box = (min(p[0] for p in xs), min(p[1] for p in xs), max(p[0] for p in xs), max(p[1] for p in xs)) if xs else None

    def inside(self, p) -> bool:
        """Whether a point off the boundary is in the area, by crossings to its right."""
        if self.box is None or not (self.box[0] <= p[0] <= self.box[2] and self.box[1] <= p[1] <= self.box[3]):
            return False
        odd = False
        y = p[1]
        for a, b in self.area_edges:
            if (a[1] > y) != (b[1] > y):
                lo, hi = (a, b) if a[1] < b[1] else (b, a)
                if p[0] < min(a[0], b[0]) or (p[0] <= max(a[0], b[0]) and orient(lo, hi, p) > 0):
                    odd = not odd
        return odd

    def locate(self, p) -> int:
        for a, b in self.area_edges:
            if _between(p, a, b) and orient(a, b, p) == 0:
                return B
        if self.inside(p):
            return I
        if p in self.points:
            return I
        for a, b in self.line_edges:
            if _between(p, a, b) and orient(a, b, p) == 0:
                return B if p in self.ends else I
        return E


def locate_many(m: Member, xs, ys):
    """``Member.locate`` for arrays of points and an input of areas only.

    Points whose side of some edge is within rounding error are located exactly, one by one.
    """
    import numpy as np

    odd, doubt = np.zeros(len(xs), bool), np.zeros(len(xs), bool)
    box = m.box
    near = (xs >= box[0]) & (xs <= box[2]) & (ys >= box[1]) & (ys <= box[3])
    at = np.flatnonzero(near)
    x, y = xs[at], ys[at]
    o, d = np.zeros(len(at), bool), np.zeros(len(at), bool)
    for a, b in m.area_edges:
        lo, hi = (a, b) if a[1] <= b[1] else (b, a)
        left = (hi[0] - lo[0]) * (y - lo[1])
        right = (hi[1] - lo[1]) * (x - lo[0])
        det = left - right
        unsure = np.abs(det) <= 4e-16 * (np.abs(left) + np.abs(right))
        d |= unsure & (y >= lo[1]) & (y <= hi[1]) & (x >= min(a[0], b[0])) & (x <= max(a[0], b[0]))
        if lo[1] != hi[1]:
            # The edge is to the right of the points that lie on its left side seen upwards.
            o ^= (y >= lo[1]) & (y < hi[1]) & (det > 0)
    odd[at], doubt[at] = o, d
    out = np.where(odd, I, E)
    for i in np.flatnonzero(doubt).tolist():
        out[i] = m.locate((float(xs[i]), float(ys[i])))
    return out


def crossing(a, b, c, d):
    """Points at which two segments meet, to be added to each of them: (on ab, on cd)."""
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return (), ()
    o1, o2 = orient(a, b, c), orient(a, b, d)
    if o1 == o2 != 0:
        return (), ()
    o3, o4 = orient(c, d, a), orient(c, d, b)
    if o3 == o4 != 0:
        return (), ()
    if o1 * o2 < 0 and o3 * o4 < 0:
        rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
        t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / (rx * sy - ry * sx)
        p = (a[0] + t * rx + 0.0, a[1] + t * ry + 0.0)
        tol = 1e-15 * max(1e-300, *(abs(v) for q in (a, b, c, d) for v in q))
        for q in (a, b, c, d):
            if abs(p[0] - q[0]) <= tol and abs(p[1] - q[1]) <= tol:
                p = q
                break
        return (p,), (p,)
    on1 = [p for p, o in ((c, o1), (d, o2)) if o == 0 and _between(p, a, b)]
    on2 = [p for p, o in ((a, o3), (b, o4)) if o == 0 and _between(p, c, d)]
    return on1, on2


def node(edges: list, points=()) -> list[list]:
    """For each edge the chain of points it passes, its ends and all meetings included."""
    cuts: list[set] = [set() for _ in edges]
    order = sorted(range(len(edges)), key=lambda i: min(edges[i][0][0], edges[i][1][0]))
    live: list[int] = []
    for i in order:
        a, b = edges[i]
        left = min(a[0], b[0])
        live = [j for j in live if max(edges[j][0][0], edges[j][1][0]) >= left]
        for j in live:
            c, d = edges[j]
            p, q = crossing(a, b, c, d)
            cuts[i].update(p)
            cuts[j].update(q)
        live.append(i)
    for p in points:
        for i, (a, b) in enumerate(edges):
            if _between(p, a, b) and orient(a, b, p) == 0:
                cuts[i].add(p)
    out = []
    for (a, b), extra in zip(edges, cuts):
        dx, dy = b[0] - a[0], b[1] - a[1]
        mid = sorted((p for p in extra if p not in (a, b)), key=lambda p: (p[0] - a[0]) * dx + (p[1] - a[1]) * dy)
        out.append([a, *mid, b])
    return out


class SubEdge:
    __slots__ = ("left", "right", "lines", "area")

    def __init__(self):
        self.left, self.right, self.lines, self.area = set(), set(), set(), set()


class Arrangement:
    """Sub-edges by (lower point, upper point) with, per side, the members whose area is there."""

    def __init__(self, members: list[Member], grid: float = 0.0):
        self.members = members
        edges, tags = [], []
        for m, x in enumerate(members):
            edges += x.area_edges + x.line_edges
            tags += [(m, True)] * len(x.area_edges) + [(m, False)] * len(x.line_edges)
        points = {p for x in members for p in x.points}
        chains = node(edges, points)
        for _ in range(6 if grid else 0):
            # Snapped meeting points move the edges between them, which may then meet others.
            chains = [[p for k, p in enumerate(c) if not k or p != c[k - 1]] for c in ([_snap(p, grid) for p in c] for c in chains)]
            edges = [(a, b) for c in chains for a, b in zip(c, c[1:])]
            tags = [t for c, t in zip(chains, tags) for _ in c[1:]]
            chains = node(edges, points)
            if all(len(c) == 2 for c in chains):
                break
        self.edges: dict[tuple, SubEdge] = {}
        for chain, (m, is_area) in zip(chains, tags):
            for p, q in zip(chain, chain[1:]):
                if p == q:
                    continue
                forward = p < q
                s = self.edges.setdefault((p, q) if forward else (q, p), SubEdge())
                if is_area:
                    s.area.add(m)
                    side = s.left if forward else s.right
                    # Twice the same side by one member cancels as rings laid over each other do.
                    side.symmetric_difference_update((m,))
                else:
                    s.lines.add(m)
        areas = [(m, x) for m, x in enumerate(members) if x.box]
        for (p, q), s in self.edges.items():
            mid = ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
            for m, x in areas:
                if m not in s.area and x.inside(mid):
                    s.left.add(m)
                    s.right.add(m)
        self.nodes = {p for e in self.edges for p in e} | points


def _edge_location(s: SubEdge, m: int) -> int:
    left, right = m in s.left, m in s.right
    if left and right:
        return I
    if left or right:
        return B
    return I if m in s.lines else E


def relate(a: Geom, b: Geom) -> str:
    """The DE-9IM matrix as nine characters."""
    members = [Member(a), Member(b)]
    best = [[-1] * 3 for _ in range(3)]
    best[E][E] = 2

    def put(x, y, d):
        best[x][y] = max(best[x][y], d)

    arr = Arrangement(members)
    on_area: list[set] = [set(), set()]
    on_line: list[set] = [set(), set()]
    for (p, q), s in arr.edges.items():
        at = [_edge_location(s, m) for m in (0, 1)]
        put(at[0], at[1], 1)
        put(I if 0 in s.left else E, I if 1 in s.left else E, 2)
        put(I if 0 in s.right else E, I if 1 in s.right else E, 2)
        for m in (0, 1):
            if at[m] == B:
                on_area[m].update((p, q))
            elif m in s.lines and at[m] == I:
                on_line[m].update((p, q))
    for p in arr.nodes:
        at = []
        for m, x in enumerate(members):
            if p in on_area[m]:
                at.append(B)
            elif x.box and x.inside(p):
                at.append(I)
            elif p in on_line[m]:
                at.append(B if p in x.ends else I)
            else:
                at.append(I if p in x.points else E)
        put(at[0], at[1], 0)
    return "".join("F012"[d + 1] for row in best for d in row)


def matches(matrix: str, pattern: str) -> bool:
    return all(p == "*" or (p == "T" and m != "F") or p == m for m, p in zip(matrix, pattern))


# Predicates as patterns on the matrix of (a, b).
PATTERNS = {
    "disjoint": ("FF*FF****",),
    "contains": ("T*****FF*",),
    "within": ("T*F**F***",),
    "covers": ("T*****FF*", "*T****FF*", "***T**FF*", "****T*FF*"),
    "covered_by": ("T*F**F***", "*TF**F***", "**FT*F***", "**F*TF***"),
    "contains_properly": ("T**FF*FF*",),
    "touches": ("FT*******", "F**T*****", "F***T****"),
    "geom_equals": ("T*F**FFF*",),
}


def predicate(name: str, a: Geom, b: Geom) -> bool:
    """A named relation of two geometries; an empty one meets nothing."""
    if a.is_empty or b.is_empty:
        return name == "disjoint" or (name == "geom_equals" and a.is_empty and b.is_empty)
    if name == "intersects":
        return not predicate("disjoint", a, b)
    p, q = a.bounds(), b.bounds()
    if p[2] < q[0] or q[2] < p[0] or p[3] < q[1] or q[3] < p[1]:
        return name == "disjoint"
    if name in ("within", "covered_by") and not (q[0] <= p[0] and q[1] <= p[1] and p[2] <= q[2] and p[3] <= q[3]):
        return False
    if name in ("contains", "covers", "contains_properly") and not (p[0] <= q[0] and p[1] <= q[1] and q[2] <= p[2] and q[3] <= p[3]):
        return False
    if a.kind == POINT or b.kind == POINT:
        x, other, flip = (a, b, False) if a.kind == POINT else (b, a, True)
        at = Member(other).locate(_xy(x.data))
        if name == "disjoint":
            return at == E
        if name == "touches":
            return at == B
        if name in (("contains", "contains_properly") if flip else ("within",)):
            return at == I
        if name == ("covers" if flip else "covered_by"):
            return at != E
    da, db = a.dimension(), b.dimension()
    m = relate(a, b)
    if name == "crosses":
        if da == db == 1:
            return m[0] == "0"
        return matches(m, "T*T******") if da < db else matches(m, "T*****T**") if da > db else False
    if name == "overlaps":
        return da == db and matches(m, "1*T***T**" if da == 1 else "T*T***T**")
    return any(matches(m, p) for p in PATTERNS[name])


# Rings, polygons and lines from edges

def polygons(directed: list[tuple]) -> list[Geom]:
    """Polygons from boundary edges with their interior on the left."""
    out: dict = defaultdict(list)
    for p, q in directed:
        out[p].append(q)
    angle = lambda p, q: math.atan2(q[1] - p[1], q[0] - p[0])
    for p in out:
        out[p].sort(key=lambda q: angle(p, q))
    used: set = set()
    shells, holes = [], []
    for start in directed:
        if start in used:
            continue
        ring, e = [start[0]], start
        while e not in used:
            used.add(e)
            p, q = e
            ring.append(q)
            nexts = out.get(q)
            if not nexts:
                break
            if len(nexts) == 1:
                e = (q, nexts[0])
                continue
            # The first edge clockwise from the way back: it bounds the same face.
            back = angle(q, p)
            turn = lambda r: (back - angle(q, r)) % (2 * math.pi) or 2 * math.pi  # noqa: E731,B023
            free = [r for r in nexts if (q, r) not in used or (q, r) == start]
            e = (q, min(free or nexts, key=turn))
        if ring[0] != ring[-1]:
            continue
        for r in _simple_rings(ring):
            a = ring_area(r)
            if len(r) >= 4 and a != 0:
                (shells if a > 0 else holes).append(r)
    shells.sort(key=lambda r: abs(ring_area(r)))
    owned: list[list] = [[] for _ in shells]
    solid = [Member(Geom(POLYGON, [r])) for r in shells]
    for h in holes:
        size = abs(ring_area(h))
        for k, (r, m) in enumerate(zip(shells, solid)):
            if abs(ring_area(r)) <= size:
                continue
            corners = set(r)
            free = [p for p in h if p not in corners] or [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(h, h[1:])]
            if m.locate(free[0]) == I or (m.locate(free[0]) == B and any(m.inside(p) for p in free)):
                owned[k].append(h)
                break
    return [Geom(POLYGON, [r, *sorted(hs)]) for r, hs in zip(shells, owned)]


def _simple_rings(ring: list) -> list[list]:
    """A closed walk cut at each vertex that it visits again."""
    out, path, at = [], [], {}
    for p in ring:
        if p in at:
            k = at[p]
            loop = path[k:] + [p]
            if len(loop) >= 4:
                out.append(loop)
            for x in path[k + 1 :]:
                at.pop(x, None)
            path = path[: k + 1]
        else:
            at[p] = len(path)
            path.append(p)
    return out


def merge_lines(edges: list[tuple]) -> list[Geom]:
    """Lines from undirected edges, joined where exactly two meet."""
    near: dict = defaultdict(list)
    for p, q in edges:
        near[p].append(q)
        near[q].append(p)
    used: set = set()
    out = []

    def walk(p, q):
        path = [p, q]
        used.add((min(p, q), max(p, q)))
        while len(near[path[-1]]) == 2:
            a, b = near[path[-1]]
            n = b if a == path[-2] else a
            key = (min(path[-1], n), max(path[-1], n))
            if key in used:
                break
            used.add(key)
            path.append(n)
        return Geom(LINE, path)

    for p in sorted(near):
        if len(near[p]) != 2:
            for q in near[p]:
                if (min(p, q), max(p, q)) not in used:
                    out.append(walk(p, q))
    for p, q in sorted(edges):
        if (min(p, q), max(p, q)) not in used:
            out.append(walk(p, q))
    return out


class Unbalanced(ArithmeticError):
    """Rounding has left boundary edges that do not close."""


def _balanced(area: list[tuple]) -> list[tuple]:
    n: dict = defaultdict(int)
    for p, q in area:
        n[p] += 1
        n[q] -= 1
    if any(n.values()):
        raise Unbalanced
    return area


def _with_grids(f, geoms: list[Geom]) -> Geom:
    """Runs ``f`` on doubles as they are and, where rounding spoils the result, on ever coarser grids."""
    size = max((abs(v) for g in geoms for v in (g.bounds() or ())), default=1.0) or 1.0
    unit = 2.0 ** math.ceil(math.log2(size))
    for grid in (0.0, *(unit * 2.0**-k for k in (46, 42, 38, 34, 30, 24))):
        try:
            return f(grid)
        except Unbalanced:
            continue
    raise ArithmeticError("no grid gives closed boundaries")


OPS = {
    "intersection": lambda a, b: a and b,
    "union": lambda a, b: a or b,
    "difference": lambda a, b: a and not b,
    "symmetric_difference": lambda a, b: a != b,
}


def overlay(op: str, a: Geom, b: Geom) -> Geom:
    """Set operation on two geometries, in the simplest type; parts of lower dimension stay where they are isolated."""
    f = OPS[op]
    if a.is_empty or b.is_empty:
        keep = {"intersection": EMPTY, "difference": EMPTY if a.is_empty else a}.get(op, b if a.is_empty else a)
        return keep if not keep.is_empty else EMPTY
    p, q = a.bounds(), b.bounds()
    if p[2] < q[0] or q[2] < p[0] or p[3] < q[1] or q[3] < p[1]:
        return EMPTY if op == "intersection" else a if op == "difference" else collect(a.parts() + b.parts())
    return _with_grids(lambda grid: _overlay(op, f, a, b, grid), [a, b])


def _overlay(op: str, f, a: Geom, b: Geom, grid: float) -> Geom:
    members = [Member(a, grid), Member(b, grid)]
    arr = Arrangement(members, grid)
    area, lines, covered = [], [], set()
    for (p, q), s in arr.edges.items():
        left, right = f(0 in s.left, 1 in s.left), f(0 in s.right, 1 in s.right)
        if left != right:
            area.append((p, q) if left else (q, p))
        if left or right:
            covered.update((p, q))
            continue
        on = [m in s.left or m in s.right or m in s.lines for m in (0, 1)]
        own = [m in s.lines for m in (0, 1)]
        if {"intersection": on[0] and on[1], "union": own[0] or own[1], "difference": own[0] and not on[1]}.get(op, (own[0] and not on[1]) or (own[1] and not on[0])):
            lines.append((p, q))
            covered.update((p, q))
    points = []
    for p in arr.nodes - covered:
        on = [x.locate(p) != E for x in members]
        own = [p in x.points for x in members]
        keep = {"intersection": on[0] and on[1], "union": own[0] or own[1], "difference": own[0] and not on[1]}.get(op, (own[0] and not on[1]) or (own[1] and not on[0]))
        if keep and not f(members[0].inside(p), members[1].inside(p)) or (keep and op == "intersection"):
            points.append(Geom(POINT, p))
    return collect(polygons(_balanced(area)) + merge_lines(lines) + sorted(points, key=lambda g: g.data))


def union_all(geoms: list[Geom]) -> Geom:
    """Union of any number of geometries from one arrangement per cluster of overlapping boxes."""
    parts = [p for g in geoms if g is not None for p in g.parts()]
    groups = _clusters(parts)
    out = [g for members in groups for g in _union_cluster(members).parts()]
    return collect(sorted(out, key=lambda g: (-g.kind, g.bounds())))


def _clusters(parts: list[Geom]) -> list[list[Geom]]:
    if len(parts) > 256:
        from tesselon.kernels import columns

        found: dict = defaultdict(list)
        for p, label in zip(parts, columns.clusters([p.bounds() for p in parts]).tolist()):
            found[label].append(p)
        return list(found.values())
    order = sorted(range(len(parts)), key=lambda i: parts[i].bounds()[0])
    up = list(range(len(parts)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    live: list[tuple] = []
    for i in order:
        b = parts[i].bounds()
        live = [(j, c) for j, c in live if c[2] >= b[0]]
        for j, c in live:
            if c[1] <= b[3] and b[1] <= c[3]:
                up[find(i)] = find(j)
        live.append((i, b))
    groups: dict = defaultdict(list)
    for i in range(len(parts)):
        groups[find(i)].append(parts[i])
    return list(groups.values())


def _union_cluster(parts: list[Geom]) -> Geom:
    if len(parts) == 1 and parts[0].kind != LINE:
        return parts[0]
    return _with_grids(lambda grid: _union_on(parts, grid), parts)


def _union_on(parts: list[Geom], grid: float) -> Geom:
    members = [Member(p, grid) for p in parts]
    arr = Arrangement(members, grid)
    area, lines, covered = [], [], set()
    for (p, q), s in arr.edges.items():
        left, right = bool(s.left), bool(s.right)
        if left != right:
            area.append((p, q) if left else (q, p))
        elif not left and s.lines:
            lines.append((p, q))
        if left or right or s.lines:
            covered.update((p, q))
    points = {p for x in members for p in x.points if p not in covered}
    points = [Geom(POINT, p) for p in sorted(points) if not any(x.inside(p) for x in members if x.box)]
    return collect(polygons(_balanced(area)) + merge_lines(lines) + points)


# Validity

def is_simple(g: Geom) -> bool:
    """No line passes a point twice except at ends that close it or that two lines share; no repeated points."""
    if g.kind == COLLECTION:
        return all(is_simple(p) for p in g.data)
    parts = g.parts()
    pts = [p.data[:2] for p in parts if p.kind == POINT]
    if len(pts) != len(set(pts)):
        return False
    paths = [[_xy(c) for c in p.data] for p in parts if p.kind == LINE]
    paths = [[c for k, c in enumerate(p) if not k or c != p[k - 1]] for p in paths]
    if not paths:
        return True
    edges = [(a, b, i, k) for i, p in enumerate(paths) for k, (a, b) in enumerate(zip(p, p[1:]))]
    for n, (a, b, i, k) in enumerate(edges):
        for c, d, j, l in edges[:n]:
            on1, on2 = crossing(a, b, c, d)
            met = {*on1, *on2}
            if not met:
                continue
            if i == j and abs(k - l) == 1:
                if met - {a if k > l else b}:
                    return False
            elif i == j:
                p = paths[i]
                if met != {p[0]} or p[0] != p[-1] or {k, l} != {0, len(p) - 2}:
                    return False
            elif any(x not in (paths[i][0], paths[i][-1]) or x not in (paths[j][0], paths[j][-1]) for x in met) or any(paths[x][0] == paths[x][-1] for x in (i, j)):
                return False
    return True


def is_valid(g: Geom) -> bool:
    """OGC validity: simple rings that may touch at points, holes inside their shells, connected interiors, disjoint parts."""
    if any(not math.isfinite(v) for c in g.coords() for v in c[:2]):
        return False
    if g.kind == COLLECTION:
        return all(is_valid(p) for p in g.data)
    for p in g.parts():
        if p.kind == LINE and len({_xy(c) for c in p.data}) < 2:
            return False
        if p.kind == POLYGON and not _valid_polygon(p):
            return False
    areas = [p for p in g.parts() if p.kind == POLYGON]
    if len(areas) > 1:
        for s in Arrangement([Member(p) for p in areas]).edges.values():
            if len(s.left) > 1 or len(s.right) > 1 or len(s.area) > 1:
                return False
    return True


def _valid_polygon(g: Geom) -> bool:
    rings = [[_xy(c) for c in r] for r in g.data]
    rings = [[c for k, c in enumerate(r) if not k or c != r[k - 1]] for r in rings]
    for r in rings:
        if len(r) < 4 or r[0] != r[-1] or len(set(r)) != len(r) - 1:
            return False
    edges = [(a, b, i, k) for i, r in enumerate(rings) for k, (a, b) in enumerate(zip(r, r[1:]))]
    touch: dict = defaultdict(set)
    for n, (a, b, i, k) in enumerate(edges):
        for c, d, j, l in edges[:n]:
            on1, on2 = crossing(a, b, c, d)
            met = {*on1, *on2}
            if not met:
                continue
            if len(met) > 1:
                return False
            (x,) = met
            if i == j:
                last = len(rings[i]) - 2
                if (abs(k - l) == 1 or {k, l} == {0, last}) and x in (a, b) and x in (c, d):
                    continue
                return False
            if x not in (a, b) and x not in (c, d):
                return False
            touch[min(i, j), max(i, j)].add(x)
    # Rings that touch in a cycle cut the interior apart.
    up: dict = {}

    def find(v):
        up.setdefault(v, v)
        while up[v] != v:
            v = up[v]
        return v

    for (i, j), pts in touch.items():
        if len(pts) > 1:
            return False
        (x,) = pts
        for v in (i, j):
            pair = ("ring", v), ("point", x)
            a, b = find(pair[0]), find(pair[1])
            if a == b and not any(k != (i, j) and x in t and v in k for k, t in touch.items()):
                return False
            up[a] = b
    solid = [Member(Geom(POLYGON, [r])) for r in rings]
    for k in range(1, len(rings)):
        inside = [solid[0].locate(p) for p in rings[k]]
        if E in inside or (I not in inside and not solid[0].inside(_mid(rings[k]))):
            return False
        for n in range(1, len(rings)):
            if n != k:
                at = [solid[n].locate(p) for p in rings[k]]
                if I in at:
                    return False
    return True


def _mid(r):
    return (r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2


def distance(a: Geom, b: Geom) -> float:
    if a.is_empty or b.is_empty:
        return math.nan
    if a.kind == POINT and b.kind == POINT:
        return math.hypot(a.data[0] - b.data[0], a.data[1] - b.data[1])
    x, y = Member(a), Member(b)
    for m, n in ((x, y), (y, x)):
        if m.box:
            for p in [*n.points, *(c[0] for c in n.lines), *(r[0] for r in n.rings)]:
                if m.locate(p) != E:
                    return 0.0
    ea, eb = ([*m.area_edges, *m.line_edges, *((p, p) for p in m.points)] for m in (x, y))
    best = math.inf
    for p, q in ea:
        for r, s in eb:
            if p != q and r != s and any(crossing(p, q, r, s)):
                return 0.0
            best = min(best, segment_distance(p, r, s), segment_distance(q, r, s), segment_distance(r, p, q), segment_distance(s, p, q))
    return best


def equals_exact(a: Geom, b: Geom, tolerance: float) -> bool:
    """Same structure and vertices in the same order, each within the tolerance in x and y."""
    if a.kind != b.kind or a.is_empty != b.is_empty:
        return False
    if a.kind > POLYGON:
        return len(a.data) == len(b.data) and all(equals_exact(p, q, tolerance) for p, q in zip(a.data, b.data))
    if a.kind == POLYGON and [len(r) for r in a.data] != [len(r) for r in b.data]:
        return False
    p, q = a.coords(), b.coords()
    return len(p) == len(q) and all(abs(u[0] - v[0]) <= tolerance and abs(u[1] - v[1]) <= tolerance for u, v in zip(p, q))


# Buffers

def buffer(g: Geom, distance: float, resolution: int = 16, cap_style: str = "round", join_style: str = "round", mitre_limit: float = 5.0, single_sided: bool = False) -> Geom:
    """Points within a distance; of areas, a negative one gives the points that far inside.  ``resolution`` segments a quarter circle."""
    if resolution < 1:
        raise ValueError("resolution must be at least 1")
    if single_sided:
        return collect([p for q in g.parts() if q.kind == LINE for p in union_all([_strip(a, b, distance) for a, b in zip(q.data, q.data[1:]) if _xy(a) != _xy(b)]).parts()])
    areas = [p for p in g.parts() if p.kind == POLYGON]
    if distance == 0:
        return union_all(areas) if areas else Geom(POLYGON, [])
    r = abs(distance)
    pieces: list[Geom] = []
    for p in areas if distance < 0 else g.parts():
        if p.kind == POINT:
            pieces += [] if cap_style == "flat" else [_square(p.data, r)] if cap_style == "square" else [_circle(p.data, r, resolution)]
            continue
        for path in [p.data] if p.kind == LINE else p.data:
            path = [_xy(c) for k, c in enumerate(path) if not k or _xy(c) != _xy(path[k - 1])]
            if len(path) == 1:
                pieces.append(_circle(path[0], r, resolution))
            pieces += _path_pieces(path, r, resolution, cap_style, join_style, mitre_limit)
    if distance > 0:
        out = union_all(areas + pieces)
    else:
        out = overlay("difference", union_all(areas), union_all(pieces)) if areas else EMPTY
    out = collect([p for p in out.parts() if p.kind == POLYGON])
    return out if not out.is_empty else Geom(POLYGON, [])


def _circle(c, r, n, start=0.0) -> Geom:
    pts = [(c[0] + r * math.cos(start + k * math.pi / 2 / n), c[1] + r * math.sin(start + k * math.pi / 2 / n)) for k in range(4 * n)]
    return Geom(POLYGON, [[*pts, pts[0]]])


def _square(c, r) -> Geom:
    x, y = c[:2]
    return Geom(POLYGON, [[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]])


def _strip(a, b, d) -> Geom:
    n = math.hypot(b[0] - a[0], b[1] - a[1])
    nx, ny = -(b[1] - a[1]) / n * d, (b[0] - a[0]) / n * d
    a, b = _xy(a), _xy(b)
    ring = [a, b, (b[0] + nx, b[1] + ny), (a[0] + nx, a[1] + ny), a]
    return Geom(POLYGON, [ring if d > 0 else ring[::-1]])


def _path_pieces(path, r, n, cap, join, limit) -> list[Geom]:
    """Strips along the segments with a piece at each corner and end."""
    closed = path[0] == path[-1]
    out = []
    segs = list(zip(path, path[1:]))
    for k, (a, b) in enumerate(segs):
        ux, uy = b[0] - a[0], b[1] - a[1]
        size = math.hypot(ux, uy)
        ux, uy = ux / size, uy / size
        back = r if cap == "square" and not closed and k == 0 else 0.0
        ahead = r if cap == "square" and not closed and k == len(segs) - 1 else 0.0
        s, e = (a[0] - ux * back, a[1] - uy * back), (b[0] + ux * ahead, b[1] + uy * ahead)
        nx, ny = -uy * r, ux * r
        at = math.atan2(-ux, uy)

        def arc(c, frm, n=n):
            return [(c[0] + r * math.cos(frm + i * math.pi / 2 / n), c[1] + r * math.sin(frm + i * math.pi / 2 / n)) for i in range(1, 2 * n)]

        right = [(s[0] - nx, s[1] - ny), (e[0] - nx, e[1] - ny)]
        left = [(e[0] + nx, e[1] + ny), (s[0] + nx, s[1] + ny)]
        round_start = (cap == "round" and not closed and k == 0) or (join == "round" and (closed or k > 0))
        round_end = (cap == "round" and not closed and k == len(segs) - 1) or (join == "round" and (closed or k < len(segs) - 1))
        ring = right + (arc(b, at) if round_end else []) + left + (arc(a, at + math.pi) if round_start else [])
        out.append(Geom(POLYGON, [[*ring, ring[0]]]))
    if join != "round":
        for k in range(0 if closed else 1, len(segs)):
            out += _corner(segs[k - 1], segs[k], r, join, limit)
    return out


def _corner(s, t, r, join, limit) -> list[Geom]:
    (a, v), (_, b) = s, t
    side = orient(a, v, b)
    if side == 0:
        return []
    unit = lambda p, q: ((q[0] - p[0]) / math.hypot(q[0] - p[0], q[1] - p[1]), (q[1] - p[1]) / math.hypot(q[0] - p[0], q[1] - p[1]))
    (ux, uy), (wx, wy) = unit(a, v), unit(v, b)
    k = -side * r
    p, q = (v[0] - uy * k, v[1] + ux * k), (v[0] - wy * k, v[1] + wx * k)
    ring = [v, p, q]
    if join == "mitre":
        half = math.cos(math.acos(max(-1.0, min(1.0, ux * wx + uy * wy))) / 2)
        mx, my = p[0] + q[0] - 2 * v[0], p[1] + q[1] - 2 * v[1]
        size = math.hypot(mx, my)
        if half > 0 and 1 / half <= limit and size > 0:
            ring = [v, p, (v[0] + mx / size * r / half, v[1] + my / size * r / half), q]
    ring = [*ring, v]
    return [Geom(POLYGON, [ring if ring_area(ring) > 0 else ring[::-1]])]
