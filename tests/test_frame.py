import math
import warnings

import pytest
from pyspark.sql import functions as F

from tesselon.kernels import geometry as G
from tesselon.operators.aggregate import dissolve
from tesselon.operators.frame import GeoFrame, concat, from_wkb, from_wkt, points_from_xy


@pytest.fixture(scope="module")
def shapes(spark):
    wkt = ["POLYGON ((0 3.5, 7 2.4, 1 0.1, 0 3.5))", "POLYGON ((0 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 1 0, 1 2, 0 2, 0 0))"]
    return GeoFrame.from_local(spark, [{"i": i, "geometry": w} for i, w in enumerate(wkt)], npartitions=2)


@pytest.fixture(scope="module")
def pts(spark):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 2), (2, 3), (3, 4), (4, 1)])], "i int, x double, y double")
    return points_from_xy(df, crs="EPSG:26918")


def values(frame, col):
    return [r[0] for r in frame.df.select("i", col.alias("v")).orderBy("i").select("v").collect()]


def wkts(frame):
    return [r.geometry for r in frame.to_wkt().orderBy("i").collect()]


def test_measures(shapes, pts):
    assert [round(v, 6) for v in values(shapes, shapes.area)] == [11.35, 0.5, 1.0, 2.0]
    assert values(shapes, shapes.geom_type) == ["Polygon"] * 4 and values(shapes, shapes.is_valid) == [True] * 4
    assert values(shapes, shapes.has_z) == [False] * 4 and values(shapes, shapes.is_empty) == [False] * 4
    assert wkts(shapes.centroid)[2] == "POINT (0.5 0.5)" and wkts(shapes.envelope)[1] == "POLYGON ((1 0, 1 1, 0 1, 0 0, 1 0))"
    assert wkts(shapes.exterior)[1] == "LINESTRING (0 0, 1 1, 0 1, 0 0)" and wkts(shapes.boundary)[1].startswith("LINESTRING")
    assert values(pts, pts.x) == [1, 2, 3, 4] and values(pts, pts.y) == [2, 3, 4, 1]
    assert [tuple(r) for r in shapes.total_bounds().collect()] == [(0.0, 0.0, 7.0, 3.5)]
    assert shapes.df.select(*shapes.bounds).count() == 4 and values(shapes, F.size(shapes.interiors)) == [0] * 4
    with pytest.raises(Exception, match="points only"):
        values(shapes, shapes.x)


def test_constructions(shapes, pts):
    assert all(v for v in values(shapes, shapes.representative_point().within("POLYGON((-9 -9,9 -9,9 9,-9 9,-9 -9))")) for v in [v is not None])
    assert [round(a, 3) for a in values(pts.buffer(1), pts.buffer(1).area)] == [3.137] * 4
    assert wkts(pts.translate(1, -1))[0] == "POINT (2 1)" and wkts(pts.affine_transform([0, 1, 1, 0, 0, 0]))[0] == "POINT (2 1)"
    assert wkts(shapes.scale(2, 2, origin=(0, 0)))[2] == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    assert wkts(shapes.rotate(90, origin=(0, 0)))[2] == "POLYGON ((0 0, 0 1, -1 1, -1 0, 0 0))"
    assert wkts(shapes.skew(45, 0, origin=(0, 0)))[2] == "POLYGON ((0 0, 1 0, 2 1, 1 1, 0 0))"
    assert wkts(shapes.simplify(0.1))[2].startswith("POLYGON") and wkts(shapes.convex_hull)[2].startswith("POLYGON")
    assert [round(a, 6) for a in values(shapes, shapes.intersection("POLYGON((0 0,1 0,1 1,0 1,0 0))").area)] != []


def test_predicates_and_crs(shapes, pts):
    unit = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    assert values(shapes, shapes.geom_equals(unit)) == [False, False, True, False]
    assert values(shapes, shapes.covers(unit)) == [False, False, True, True]
    assert values(shapes, shapes.within("POLYGON ((-1 -1, 2 -1, 2 3, -1 3, -1 -1))")) == [False, True, True, True]
    assert values(shapes, shapes.relate(unit))[2] == "2FFF1FFF2"
    assert values(pts, pts.within("POLYGON ((1 2, 4 2, 4 5, 1 5, 1 2))")) == [False, True, True, False]
    assert values(pts, pts.touches("POLYGON ((1 2, 4 2, 4 5, 1 5, 1 2))")) == [True, False, False, False]
    assert values(pts, pts.distance("POINT (1 2)"))[1] == math.hypot(1, 1)
    assert values(shapes, shapes.geom_equals_exact(unit, 1e-9))[2] and values(shapes, shapes.equal_to(unit))[2]
    assert pts.crs == "EPSG:26918"
    with pytest.raises(ValueError, match="already has a CRS which is not equal to the passed CRS"):
        pts.set_crs("EPSG:4326")
    assert pts.set_crs("EPSG:4326", allow_override=True).crs == "EPSG:4326"
    lonlat = points_from_xy(pts.df.select("i", "x", "y"), crs="EPSG:4326")
    back = lonlat.to_crs(3857).to_crs(epsg=32631).to_crs("EPSG:4326")
    assert all(abs(a - b) < 1e-8 for a, b in zip(values(back, back.x), [1, 2, 3, 4]))
    with pytest.raises(ValueError):
        pts.to_crs("EPSG:4316")


def test_columns_and_demotion(shapes):
    assert isinstance(shapes.drop(columns="i"), GeoFrame) and not isinstance(shapes.drop(columns="geometry"), GeoFrame)
    with pytest.raises(TypeError):
        shapes.drop()
    with pytest.raises(NotImplementedError):
        shapes.drop("i")
    with pytest.raises(ValueError, match="No axis named 2"):
        shapes.drop("i", axis=2)
    g = shapes.rename_geometry("shape")
    assert g.name == "shape" and g.columns == ["i", "shape"]
    with pytest.raises(ValueError, match="Column named i already exists"):
        shapes.rename_geometry("i")
    assert len(shapes[shapes.df.i > 1]) == 2 and isinstance(shapes[["i"]], type(shapes.df)) and len(concat([shapes, shapes])) == 8
    with pytest.raises(NotImplementedError):
        shapes.sindex
    assert shapes.assign(j=F.col("i") + 1).columns == ["i", "geometry", "j"]
    assert shapes.compute().shape == (4, 2) and shapes.to_df().columns == ["i", "geometry"]


def test_text_and_bytes(spark):
    df = spark.createDataFrame([(0, "POINT Z (1 2 3)"), (1, "POLYGON EMPTY"), (2, None), (3, "MULTIPOINT ((0 0), (1 1))")], "i int, wkt string")
    g = from_wkt(df, "wkt", crs=4326)
    assert wkts(g) == ["POINT Z (1 2 3)", "POLYGON EMPTY", None, "MULTIPOINT ((0 0), (1 1))"] and g.crs == "EPSG:4326"
    assert values(g, g.is_empty) == [False, True, False, False] and values(g, g.isna()) == [False, False, True, False]
    h = from_wkb(g.to_wkb(hex=True), "geometry")
    assert wkts(h) == wkts(g) and values(h, h.has_z)[0]
    assert [r.z for r in h.df.filter("i = 0").select(h.z.alias("z")).collect()] == [3.0]
    assert wkts(g.fillna("POINT (9 9)"))[2] == "POINT (9 9)"
    e = g.explode(index_parts=True)
    assert sorted((r.i, r.index_parts) for r in e.df.filter("i = 3").collect()) == [(3, 0), (3, 1)]
    big = b"\x00\x00\x00\x00\x01" + __import__("struct").pack(">dd", 1, 2)
    assert G.to_wkt(G.from_wkb(big)) == "POINT (1 2)" and G.from_wkb(bytes.fromhex("0101000020E6100000000000000000F03F0000000000000040")).data == (1, 2)


def test_dissolve_and_union(spark):
    rows = [{"k": k, "v": v, "geometry": G.box(x, 0, x + 1, 1)} for k, v, x in (("a", 1, 0), ("a", 2, 1), ("b", 3, 5), (None, 4, 9), ("b", None, 6))]
    g = GeoFrame.from_local(spark, rows).with_row_id()
    for large in (True, False):
        d = dissolve(g, "k", "sum", large_groups=large)
        assert sorted((r.k, r.v, r.a) for r in d.df.select("k", "v", d.area.alias("a")).collect()) == [("a", 3.0, 2.0), ("b", 3.0, 2.0)]
    first = g.dissolve("k")
    assert sorted((r.k, r.v) for r in first.df.collect()) == [("a", 1.0), ("b", 3.0)]
    assert g.dissolve("k", {"v": "max"}).columns == ["k", "v", "geometry"]
    whole = g.dissolve(None, "count")
    assert [(r.v, r.a) for r in whole.df.select("v", whole.area.alias("a")).collect()] == [(4, 5.0)]
    assert G.from_wkb(bytes(g.union_all().first().geometry)).kind == G.MULTIPOLYGON
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        g.unary_union()
    assert w[0].category is FutureWarning
