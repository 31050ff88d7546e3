import math
import random

from tesselon.functions import st
from tesselon.kernels import columns as K
from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M


def shapes():
    rnd = random.Random(3)
    p = lambda: (rnd.uniform(-9, 9), rnd.uniform(-9, 9))
    out = ["POINT (1 2)", "POLYGON EMPTY", "LINESTRING (0 0, 0 0)", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", "LINESTRING Z (0 0 1, 3 4 2)", "MULTIPOINT ((0 0), (1 1))"]
    geoms = [G.from_wkt(t) for t in out]
    for _ in range(200):
        c = [p() for _ in range(rnd.randint(3, 6))]
        geoms.append(G.line(c) if rnd.random() < 0.5 else G.polygon([*c, c[0]]))
    return geoms


def test_columns_equal_the_kernels():
    geoms = shapes()
    values = [None, *[G.to_wkb(g) for g in geoms]]
    for fast, slow in ((K.area, M.area), (K.length, M.length)):
        out, left = fast(values)
        assert 0 < len(left) < 12 and 0 not in left
        for i, g in enumerate(geoms, 1):
            if i not in left:
                assert math.isclose(out[i], slow(g), rel_tol=1e-12, abs_tol=1e-12)
    x, y, left = K.centroid(values)
    for i, g in enumerate(geoms, 1):
        if i not in left:
            want = M.centroid(g).coords()[0]
            assert math.isclose(x[i], want[0], rel_tol=1e-7, abs_tol=1e-7) and math.isclose(y[i], want[1], rel_tol=1e-7, abs_tol=1e-7)


def test_functions_over_mixed_columns(spark):
    geoms = shapes()
    df = spark.createDataFrame([(i, None if g is None else bytearray(G.to_wkb(g))) for i, g in enumerate([*geoms, None])], "i int, g binary")
    for r in df.select("i", st.area("g").alias("a"), st.length("g").alias("l"), st.centroid("g").alias("c")).collect():
        if r.i == len(geoms):
            assert r.a is None and r.l is None and r.c.wkb is None
            continue
        g = geoms[r.i]
        assert math.isclose(r.a, M.area(g), abs_tol=1e-12, rel_tol=1e-12) and math.isclose(r.l, M.length(g), abs_tol=1e-12, rel_tol=1e-12)
        c = M.centroid(g)
        got = G.from_wkb(bytes(r.c.wkb))
        assert got.is_empty == c.is_empty and (c.is_empty or math.dist(got.coords()[0][:2], c.coords()[0][:2]) < 1e-6 and r.c.xmin == got.coords()[0][0])
