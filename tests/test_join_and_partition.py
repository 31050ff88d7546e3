import random

import pytest
from pyspark.sql import functions as F

from tesselon.kernels import geometry as G
from tesselon.kernels import topology as T
from tesselon.operators.frame import GeoFrame, boxes_from_bounds, from_wkt, points_from_xy
from tesselon.operators.sjoin import PREDICATES


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(4)
    geoms = lambda n: [G.box(x, y, x + w, y + h) for x, y, w, h in ((rnd.randint(-9, 9), rnd.randint(-9, 9), rnd.choice([1, 2, 15]), rnd.choice([1, 3])) for _ in range(n))]
    a = geoms(25) + [G.point(rnd.randint(-9, 9), rnd.randint(-9, 9)) for _ in range(10)] + [G.line([(0, 0), (3, 3)]), None, G.Geom(G.POLYGON, [])]
    b = geoms(25) + [G.polygon([(0, 0), (4, 0), (2, 3)])]
    frame = lambda gs, k: GeoFrame.from_local(spark, [{k: i, "v": i, "geometry": g} for i, g in enumerate(gs)])
    return a, b, frame(a, "i"), frame(b, "j")


@pytest.mark.parametrize("predicate", PREDICATES)
def test_join_equals_brute_force(sides, predicate):
    a, b, left, right = sides
    want = sorted((i, j) for i, g in enumerate(a) for j, h in enumerate(b) if g is not None and T.predicate(predicate, g, h))
    out = left.sjoin(right, predicate=predicate)
    assert out.columns == ["i", "v_left", "geometry", "j", "v_right"]
    assert sorted((r.i, r.j) for r in out.df.select("i", "j").collect()) == want


def test_join_kinds_and_errors(sides):
    a, b, left, right = sides
    hit = {r.i for r in left.sjoin(right).df.select("i").collect()}
    assert {r.i for r in left.sjoin(right, how="semi").df.select("i").collect()} == hit
    assert {r.i for r in left.sjoin(right, how="anti").df.select("i").collect()} == set(range(len(a))) - hit
    assert {r.i for r in left.sjoin(right, how="left").df.filter("j is null").select("i").collect()} == set(range(len(a))) - hit
    assert left.sjoin(right.filter("j < 0")).df.count() == 0
    with pytest.raises(NotImplementedError):
        left.sjoin(right, how="right")
    with pytest.raises(ValueError):
        left.sjoin(right, predicate="near")
    plan = left.sjoin(right).df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("predicate", ["intersects", "within", "contains", "covers", "covered_by", "touches", "overlaps", "crosses"])
def test_arithmetic_relations_equal_the_kernel(spark, predicate):
    cells = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in range(4) for y in range(4))]
    pts = points_from_xy(spark.createDataFrame(cells, "i int, x double, y double"))
    bx = [(i, float(a), float(b), float(a + w), float(b + h)) for i, (a, b, w, h) in enumerate((a, b, w, h) for a in range(3) for b in range(3) for w in (1, 2) for h in (1, 2))]
    boxes = boxes_from_bounds(spark.createDataFrame(bx, "j int, a double, b double, c double, d double"), "a", "b", "c", "d")
    for left, right, gs, hs in ((pts, boxes, [G.point(*c[1:]) for c in cells], [G.box(*c[1:]) for c in bx]), (boxes, pts, [G.box(*c[1:]) for c in bx], [G.point(*c[1:]) for c in cells])):
        out = left.sjoin(right, predicate=predicate).df
        assert sorted(map(tuple, out.select(left.df.columns[0], right.df.columns[0]).collect())) == sorted((i, j) for i, g in enumerate(gs) for j, h in enumerate(hs) if T.predicate(predicate, g, h))
        assert "Python" not in out.select(left.df.columns[0])._jdf.queryExecution().executedPlan().toString()


def test_cx_and_clip(spark, sides):
    a, _, left, _ = sides
    window = G.box(-2, -1, 3, 2)
    want = {i for i, g in enumerate(a) if g is not None and T.predicate("intersects", g, window)}
    assert {r.i for r in left.cx[-2:3, -1:2].df.collect()} == want == {r.i for r in left.cx[3:-2, 2:-1].df.collect()}
    assert {r.i for r in left.cx[:, :].df.collect()} == {i for i, g in enumerate(a) if g is not None and not g.is_empty}
    assert left.cx[100:, :].df.count() == 0
    with pytest.raises(ValueError):
        left.cx[0:1:2, :]
    cut = left.clip(window)
    got = {r.i: r.area for r in cut.df.select("i", cut.area.alias("area")).collect()}
    assert set(got) == want and all(abs(got[i] - __import__("tesselon.kernels.measures", fromlist=["x"]).area(T.overlay("intersection", a[i], window))) < 1e-12 for i in want)
    assert all(r.t in ("Polygon", "MultiPolygon") for r in left.filter("i < 25").clip(window, keep_geom_type=True).df.select(F.expr("1"), left.geom_type.alias("t")).collect())
    with pytest.raises(NotImplementedError):
        left.clip(left)


GOLD = {2: [0, 10, 15, 2], 3: [0, 42, 63, 10], 16: [0, 2863311530, 4294967295, 715827882]}


def test_curves(spark):
    df = spark.createDataFrame([(0, "POINT (0 0)"), (1, "POINT (1 1)"), (2, "POINT (1 0)"), (3, "POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))"), (4, None), (5, "POLYGON EMPTY")], "i int, w string")
    g = from_wkt(df, "w")
    for level, want in GOLD.items():
        got = [r.hilbert_distance for r in g.hilbert_distance(level=level).df.orderBy("i").collect()]
        assert got == [*want, None, None]
    morton = [r.morton_distance for r in g.morton_distance(level=16).df.orderBy("i").collect()]
    assert morton[:4] == [0, 2**32 - 1, int("01" * 16, 2), sum(1 << k for k in range(30))]
    for f in (g.hilbert_distance, g.morton_distance):
        with pytest.raises(ValueError):
            f(level=17)
    p = points_from_xy(spark.createDataFrame([(0, 1.0, 2.0), (1, -105.1, 40.2), (2, 0.0, 90.0)], "i int, x double, y double"))
    assert [r.geohash for r in p.geohash().df.orderBy("i").collect()][:2] == ["s02equ04ven0", "9xjk8qhtbrpu"]
    assert [r.geohash for r in p.geohash(as_string=False).df.orderBy("i").collect()][:2] == [864776574687098496, 357528495067586234]
    assert p.geohash(precision=3).df.filter("i = 2").first().geohash.startswith(("u", "b", "g", "z"))
    with pytest.raises(ValueError):
        p.geohash(as_string=False, precision=13)


@pytest.mark.parametrize("level", [1, 2, 3, 5, 6])
def test_hilbert_visits_each_cell_and_goes_to_a_neighbour(spark, level):
    n = 2**level
    df = spark.range(n * n).select(F.expr(f"id % {n}").cast("double").alias("x"), F.expr(f"id div {n}").cast("double").alias("y"))
    rows = points_from_xy(df).hilbert_distance((0, 0, n - 1, n - 1), level=level, name="h").df.select("h", "x", "y").collect()
    at = {r.h: (r.x, r.y) for r in rows}
    assert sorted(at) == list(range(n * n)) and at[0] == (0, 0) and at[n * n - 1] == (n - 1, 0)
    assert all(abs(at[h][0] - at[h + 1][0]) + abs(at[h][1] - at[h + 1][1]) == 1 for h in range(n * n - 1))


def test_spatial_shuffle(spark):
    rnd = random.Random(2)
    p = points_from_xy(spark.createDataFrame([(i, rnd.random(), rnd.random()) for i in range(500)], "i int, x double, y double"))
    for by in ("hilbert", "morton", "geohash"):
        s = p.spatial_shuffle(by, npartitions=4)
        col = "geohash" if by == "geohash" else f"{by}_distance"
        keys = [r[0] for r in s.df.select(col).collect()]
        assert keys == sorted(keys) and len(keys) == 500 and s.spatial_partitions is not None
    d = p.spatial_shuffle("hilbert", divisions=[0, 2**30, 2**31, 2**32], calculate_partitions=False)
    assert d.npartitions == 3
    got = d.df.groupBy(F.spark_partition_id().alias("p")).agg(F.min("hilbert_distance").alias("a"), F.max("hilbert_distance").alias("b")).orderBy("p").collect()
    assert got[0].b < 2**30 <= got[1].a and got[1].b < 2**31 <= got[2].a
    with pytest.raises(ValueError):
        p.spatial_shuffle("zorder")
    e = p.repartition(3).persist().calculate_spatial_partitions(hull=True).spatial_partitions
    assert e.count() == 3 and "hull" in e.columns
    with pytest.raises(TypeError):
        p.with_spatial_partitions("x")
