import random

import tesselon
from tesselon.kernels import geometry as G
from tesselon.kernels import topology as T
from tesselon.operators.frame import ROW_ID


def test_exports():
    assert all(getattr(tesselon, n) is not None for n in tesselon.__all__)


def test_series(spark):
    g = tesselon.from_local(spark, [{"i": i, "geometry": G.box(i, 0, i + 1, 1)} for i in range(3)], crs="EPSG:4326")
    s = g.series
    assert isinstance(s, tesselon.GeoSeries) and s.columns == ["geometry"] and s.crs == "EPSG:4326"
    assert isinstance(s.buffer(1), tesselon.GeoSeries) and isinstance(s.filter("true"), tesselon.GeoSeries)
    assert s.to_frame("shape").columns == ["shape"] and len(s.centroid) == 3
    assert len(s.cx[0.5:1.5, :]) == 2 and len(s.clip(G.box(0, 0, 0.5, 0.5))) == 1


def test_nearest_equals_brute_force(spark):
    rnd = random.Random(3)
    a = [G.point(rnd.random() * 100, rnd.random() * 100) for _ in range(40)] + [None]
    b = [G.box(x, y, x + 1, y + 1) for x, y in ((rnd.random() * 20, rnd.random() * 20) for _ in range(30))]
    frame = lambda gs: tesselon.from_local(spark, [{ROW_ID: i, "geometry": g} for i, g in enumerate(gs)])
    got = {}
    for r in sorted(map(tuple, tesselon.sjoin_nearest(frame(a), frame(b), k=2).collect()), key=lambda r: (r[0], r[2], r[1])):
        got.setdefault(r[0], []).append(r[1])
    want = {i: [j for _, j in sorted((T.distance(g, h), j) for j, h in enumerate(b))[:2]] for i, g in enumerate(a) if g is not None}
    assert got == want
    near = {r.left_id for r in tesselon.sjoin_nearest(frame(a), frame(b), max_distance=5).collect()}
    assert near == {i for i, g in enumerate(a) if g is not None and min(T.distance(g, h) for h in b) <= 5}
