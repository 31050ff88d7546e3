import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.kernels import topology as T


def star(rnd, n, size=1.0, cx=None, cy=None):
    cx, cy = rnd.random() if cx is None else cx, rnd.random() if cy is None else cy
    turns = sorted(rnd.random() * 2 * math.pi for _ in range(n))
    return G.polygon([(cx + math.cos(t) * r, cy + math.sin(t) * r) for t, r in ((t, size * (rnd.random() + 0.2)) for t in turns)])


def test_overlay_identities():
    rnd = random.Random(1)
    for _ in range(60):
        p, q = star(rnd, 12), star(rnd, 9)
        if not (T.is_valid(p) and T.is_valid(q)):
            continue
        i, u, d, s = (T.overlay(o, p, q) for o in ("intersection", "union", "difference", "symmetric_difference"))
        a = M.area
        assert abs(a(i) + a(u) - a(p) - a(q)) < 1e-9 and abs(a(d) + a(i) - a(p)) < 1e-9 and abs(a(s) + a(i) - a(u)) < 1e-9
        assert all(T.is_valid(x) for x in (i, u, d, s))
        for name, back in (("within", "contains"), ("covers", "covered_by"), ("intersects", "intersects"), ("touches", "touches")):
            assert T.predicate(name, p, q) == T.predicate(back, q, p)


ints = hs.integers(0, 4)


@settings(max_examples=120, deadline=None)
@given(hs.lists(hs.tuples(ints, ints, hs.integers(1, 3), hs.integers(1, 3)), min_size=1, max_size=5))
def test_union_of_grid_boxes(boxes):
    cells = {(x, y) for a, b, w, h in boxes for x in range(a, a + w) for y in range(b, b + h)}
    u = T.union_all([G.box(a, b, a + w, b + h) for a, b, w, h in boxes])
    assert abs(M.area(u) - len(cells)) < 1e-9 and T.is_valid(u)


@settings(max_examples=120, deadline=None)
@given(hs.tuples(ints, ints, hs.integers(1, 3), hs.integers(1, 3)), hs.tuples(ints, ints, hs.integers(1, 3), hs.integers(1, 3)))
def test_box_relations(p, q):
    a, b = G.box(p[0], p[1], p[0] + p[2], p[1] + p[3]), G.box(q[0], q[1], q[0] + q[2], q[1] + q[3])
    (ax, ay, az, aw), (bx, by, bz, bw) = a.bounds(), b.bounds()
    meet, inner = ax <= bz and bx <= az and ay <= bw and by <= aw, ax < bz and bx < az and ay < bw and by < aw
    within = bx <= ax and az <= bz and by <= ay and aw <= bw
    assert T.predicate("intersects", a, b) == meet and T.predicate("touches", a, b) == (meet and not inner) and T.predicate("within", a, b) == within
    assert T.predicate("geom_equals", a, b) == (a.bounds() == b.bounds())
    assert T.relate(a, b) == "".join(T.relate(b, a)[3 * j + i] for i in range(3) for j in range(3))


def test_relations_by_hand():
    unit = G.box(0, 0, 2, 2)
    r = lambda a, b: T.relate(G.from_wkt(a) if isinstance(a, str) else a, G.from_wkt(b) if isinstance(b, str) else b)
    assert r(unit, G.box(1, 1, 3, 3)) == "212101212" and r(unit, G.box(2, 0, 3, 2)) == "FF2F11212"
    assert r("LINESTRING (0 0, 2 2)", unit) == "1FFF0F212" and r("LINESTRING (-1 1, 3 1)", unit) == "101FF0212"
    assert r("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)") == "0F1FF0102" and r("POINT (0 0)", "LINESTRING (0 0, 1 0)") == "F0FFFF102"
    line = G.from_wkt("LINESTRING (-1 1, 3 1)")
    assert T.predicate("crosses", line, unit) and T.predicate("overlaps", G.line([(0, 0), (2, 0)]), G.line([(1, 0), (3, 0)]))
    assert not T.predicate("intersects", G.EMPTY, unit) and T.predicate("disjoint", G.EMPTY, unit)


def test_lines_points_and_collections():
    unit = G.box(0, 0, 2, 2)
    assert M.length(T.overlay("intersection", G.line([(-1, 1), (3, 1)]), unit)) == 2
    assert M.length(T.overlay("difference", G.line([(-1, 1), (3, 1)]), unit)) == 2
    assert G.to_wkt(T.overlay("intersection", unit, G.box(2, 2, 3, 3))) == "POINT (2 2)"
    assert T.overlay("union", unit, G.point(5, 5)).name == "GeometryCollection" and T.overlay("union", unit, G.point(1, 1)).name == "Polygon"
    hole = T.overlay("difference", G.box(0, 0, 9, 9), G.box(3, 3, 6, 6))
    assert len(hole.data) == 2 and M.area(hole) == 72 and T.predicate("within", G.box(3, 3, 6, 6), hole) is False
    assert T.distance(G.box(0, 0, 1, 1), G.box(4, 5, 6, 6)) == 5 and T.distance(unit, G.point(1, 1)) == 0


def test_validity_and_simplicity():
    bad = ["POLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (8 8, 12 8, 12 9, 8 8))", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((1 1, 3 1, 3 3, 1 3, 1 1)))"]
    good = ["POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (0 0, 2 1, 1 2, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((1 1, 2 1, 2 2, 1 1)))", "LINESTRING (0 0, 1 1)"]
    assert [T.is_valid(G.from_wkt(w)) for w in bad + good] == [False] * 3 + [True] * 3
    assert T.is_simple(G.from_wkt("LINESTRING (0 0, 1 0, 1 1, 0 0)")) and not T.is_simple(G.from_wkt("LINESTRING (0 0, 2 2, 2 0, 0 2)"))


def test_buffers():
    assert abs(M.area(T.buffer(G.point(0, 0), 1)) - 32 * 2 * math.sin(math.pi / 32) / 2 * 1) < 1e-9
    unit = G.box(0, 0, 2, 2)
    assert abs(M.area(T.buffer(unit, 1)) - (4 + 8 + M.area(T.buffer(G.point(0, 0), 1)))) < 1e-6
    assert M.area(T.buffer(unit, -0.5)) == pytest.approx(1) and T.buffer(unit, -2).is_empty
    flat = G.line([(0, 0), (3, 0)])
    assert M.area(T.buffer(flat, 1, cap_style="flat")) == pytest.approx(6) and M.area(T.buffer(flat, 1, cap_style="square")) == pytest.approx(10)
    assert M.area(T.buffer(unit, 1, join_style="mitre")) == pytest.approx(16) and M.area(T.buffer(unit, 1, join_style="bevel")) == pytest.approx(14)
    assert M.area(T.buffer(flat, 2, single_sided=True)) == pytest.approx(6)


coord = hs.tuples(hs.floats(-1e6, 1e6), hs.floats(-1e6, 1e6))


@settings(max_examples=80, deadline=None)
@given(hs.lists(coord, min_size=2, max_size=6), hs.booleans())
def test_codecs_round_trip(c, z):
    g = G.Geom(G.LINE, [(*p, 1.5) if z else p for p in c], z)
    assert G.from_wkb(G.to_wkb(g)) == g and G.from_wkt(G.to_wkt(g, -1, False)) == g and G.from_mapping(G.to_mapping(g)) == g
    m = G.Geom(G.COLLECTION, [g, G.Geom(G.POINT, None, z), G.Geom(G.MULTIPOINT, [G.Geom(G.POINT, g.data[0], z)], z)], z)
    assert G.from_wkb(G.to_wkb(m)) == m


def test_lines_measures():
    l = G.line([(0, 0), (3, 0), (3, 4)])
    assert M.interpolate(l, 5).data == (3, 2) and M.interpolate(l, -1).data == (3, 3) and M.interpolate(l, 0.5, True).data == (3, 0.5)
    assert M.project(l, G.point(9, 2)) == 5 and M.project(l, G.point(9, 2), True) == 5 / 7
    assert M.simplify(G.line([(0, 0), (1, 0.01), (2, 0)]), 0.1).data == [(0, 0), (2, 0)]
    assert G.to_wkt(M.boundary(l)) == "MULTIPOINT ((0 0), (3 4))" and M.boundary(G.EMPTY) is None
    for bad in ("POINT (1", "CIRCLE (1 2)", "POINT (1 2) x"):
        with pytest.raises(ValueError):
            G.from_wkt(bad)
    with pytest.raises(ValueError):
        G.from_wkb(b"\x01\x01\x00\x00\x00")


def test_locating_many_points_equals_one_by_one():
    import numpy as np

    rnd = random.Random(3)
    shapes = [G.from_wkt("POLYGON ((0 0, 6 0, 6 6, 3 3, 0 6, 0 0), (1 1, 2 1, 2 2, 1 1))"), G.from_wkt("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 0)), ((3 3, 6 3, 6 6, 3 3)))"), star(rnd, 40, 3, 3, 3)]
    pts = [(x / 2, y / 2) for x in range(-2, 15) for y in range(-2, 15)] + [(rnd.random() * 6, rnd.random() * 6) for _ in range(300)] + [(0.1 * k, 0.1 * k) for k in range(60)]
    for g in shapes:
        m = T.Member(g)
        got = T.locate_many(m, np.array([p[0] for p in pts]), np.array([p[1] for p in pts]))
        assert got.tolist() == [m.locate(p) for p in pts]
