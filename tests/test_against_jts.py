"""The kernels against the topology library on Spark's own class path, where there is one."""

import math
import random

import pytest

from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.kernels import topology as T


@pytest.fixture(scope="module")
def jts(spark):
    jvm = spark.sparkContext._jvm
    try:
        reader = jvm.org.locationtech.jts.io.WKTReader()
        reader.read("POINT (0 0)")
    except Exception:
        pytest.skip("no JTS here")
    return lambda g: reader.read(G.to_wkt(g, -1, False))


def shapes(seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.randint(0, 4)
        p = lambda: (rnd.randint(0, 6), rnd.randint(0, 6))
        if k == 0:
            out.append(G.point(*p()))
        elif k == 1:
            out.append(G.line([p(), p(), p()]))
        elif k == 2:
            x, y = p()
            out.append(G.box(x, y, x + rnd.randint(1, 4), y + rnd.randint(1, 4)))
        else:
            c = (rnd.random() * 6, rnd.random() * 6)
            turns = sorted(rnd.random() * 2 * math.pi for _ in range(rnd.randint(5, 9)))
            out.append(G.polygon([(c[0] + math.cos(t) * r, c[1] + math.sin(t) * r) for t, r in ((t, 1 + 3 * rnd.random()) for t in turns)]))
    return [g for g in out if T.is_valid(g)]


def test_relations(jts):
    gs = shapes(1, 40)
    js = [jts(g) for g in gs]
    bad = [(G.to_wkt(a), G.to_wkt(b), T.relate(a, b), str(ja.relate(jb))) for a, ja in zip(gs, js) for b, jb in zip(gs[::3], js[::3]) if T.relate(a, b) != str(ja.relate(jb))]
    assert not bad, bad[:3]


def test_overlays_and_distance(jts):
    gs = shapes(2, 30)
    js = [jts(g) for g in gs]
    names = {"intersection": "intersection", "union": "union", "difference": "difference", "symmetric_difference": "symDifference"}
    for a, ja in zip(gs, js):
        for b, jb in zip(gs[::4], js[::4]):
            for op, name in names.items():
                want, got = getattr(ja, name)(jb), T.overlay(op, a, b)
                assert M.area(got) == pytest.approx(want.getArea(), abs=1e-9) and M.length(got) == pytest.approx(want.getLength(), abs=1e-9), (op, G.to_wkt(a), G.to_wkt(b))
            assert T.distance(a, b) == pytest.approx(ja.distance(jb), abs=1e-9)


def test_single_geometries(jts):
    rnd = random.Random(5)
    for g in shapes(3, 60):
        j = jts(g)
        assert M.area(g) == pytest.approx(j.getArea()) and M.length(g) == pytest.approx(j.getLength())
        c = j.getCentroid()
        assert M.centroid(g).data == pytest.approx((c.getX(), c.getY())) and T.is_simple(g) == j.isSimple()
        assert M.area(M.convex_hull(g)) == pytest.approx(j.convexHull().getArea())
        if rnd.random() < 0.4:
            assert M.area(T.buffer(g, 0.7)) == pytest.approx(j.buffer(0.7, 16).getArea(), rel=2e-3)
            if g.kind == G.POLYGON:
                assert M.area(T.buffer(g, -0.3)) == pytest.approx(j.buffer(-0.3, 16).getArea(), rel=2e-2, abs=1e-3)


def test_validity(jts):
    rnd = random.Random(7)
    for _ in range(150):
        ring = [(rnd.randint(0, 4), rnd.randint(0, 4)) for _ in range(rnd.randint(3, 6))]
        hole = [(rnd.randint(0, 4), rnd.randint(0, 4)) for _ in range(3)]
        g = G.polygon(ring, [hole] if rnd.random() < 0.5 else [])
        assert T.is_valid(g) == jts(g).isValid(), G.to_wkt(g)
