"""How many rows the spatial join places, and what its predicates push down."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tesselon.operators import aggregate
from tesselon.operators.frame import boxes_from_bounds, from_wkt, points_from_xy
from tesselon.operators.sjoin import SPREAD, _cells, grid


def world(spark, n=20_000, m=2_000):
    rnd = random.Random(5)
    pts = points_from_xy(spark.createDataFrame([(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(n)], "i int, x double, y double"))
    rows = [(j, (x := rnd.uniform(0, 99)), (y := rnd.uniform(0, 99)), x + 0.5, y + 0.5) for j in range(m)] + [(m, 0.0, 0.0, 100.0, 100.0)]
    return pts, boxes_from_bounds(spark.createDataFrame(rows, "j int, x0 double, y0 double, x1 double, y1 double"), "x0", "y0", "x1", "y1")


def test_one_box_over_everything_neither_multiplies_rows_nor_makes_a_hot_key(spark):
    pts, boxes = world(spark)
    g = grid(pts.df, "geometry__bbox", boxes.df, "geometry__bbox")
    placed = _cells(pts.df, "geometry__bbox", g, g.right)
    assert placed.count() <= 2 * 20_000
    assert placed.groupBy("_level", "_cx", "_cy").count().agg(F.max("count")).first()[0] < 20_000 / 50
    assert _cells(boxes.df, "geometry__bbox", g, g.left).count() <= 4 * 2_000 + (2 * SPREAD + 1) ** 2
    got = {(r.i, r.j) for r in pts.sjoin(boxes, predicate="within").df.select("i", "j").collect()}
    p = [(r.i, r.x, r.y) for r in pts.df.select("i", "x", "y").collect()]
    b = [(r.j, r.x0, r.y0, r.x1, r.y1) for r in boxes.df.select("j", "x0", "y0", "x1", "y1").collect()]
    assert got == {(i, j) for i, x, y in p for j, x0, y0, x1, y1 in b if x0 < x < x1 and y0 < y < y1}


@pytest.mark.parametrize("seed", range(3))
def test_boxes_of_all_sizes_meet_once(spark, seed):
    rnd = random.Random(seed)

    def boxes(n):
        rows = []
        for i in range(n):
            w, h = (10 ** rnd.uniform(-4, 2.5) if rnd.random() < 0.8 else 0.0 for _ in range(2))
            x, y = rnd.choice([rnd.uniform(-100, 100), float(rnd.randint(-8, 8) * 8)]), rnd.uniform(-100, 100)
            rows.append((i, x, y, x + w + 1e-9, y + h + 1e-9))
        return rows

    a, b = boxes(150), boxes(120)
    left = boxes_from_bounds(spark.createDataFrame(a, "i int, x0 double, y0 double, x1 double, y1 double"), "x0", "y0", "x1", "y1")
    right = boxes_from_bounds(spark.createDataFrame(b, "j int, x0 double, y0 double, x1 double, y1 double"), "x0", "y0", "x1", "y1")
    got = sorted((r.i, r.j) for r in left.sjoin(right.drop(columns=["x0", "y0", "x1", "y1"])).df.select("i", "j").collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])


@pytest.mark.parametrize("name", ["within", "intersects", "contains", "covers", "covered_by", "touches", "crosses", "overlaps", "geom_equals"])
def test_box_conjuncts_of_predicates_reach_the_files(spark, tmp_path, name):
    pts, boxes = world(spark, 200, 20)
    boxes.df.write.parquet(f"{tmp_path}/b")
    from tesselon.operators.frame import GeoFrame

    f = GeoFrame(spark.read.schema(boxes.df.schema).parquet(f"{tmp_path}/b"))
    found = f.filter(getattr(f, name)("POLYGON ((0 0, 40 0, 20 40, 0 0))")).df
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan)[1]
    assert all(f"geometry__bbox.{k}" in pushed for k in ("xmin", "xmax", "ymin", "ymax"))


def test_predicates_with_box_tests_equal_the_kernel(spark):
    from tesselon.functions import st

    shapes = ["POINT (1 1)", "POINT EMPTY", None, "LINESTRING (0 0, 5 5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((10 10, 12 10, 12 12, 10 10))", "POLYGON EMPTY", "POLYGON ((0 0, 4 0, 2 4, 0 0))"]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in shapes for b in shapes)]
    f = from_wkt(spark.createDataFrame(pairs, "i int, a string, b string"), "a", name="g")
    f, other = from_wkt(f.df, "b", name="h").set_geometry("g"), "h"
    for name in st.PREDICATES:
        rows = f.df.select("i", getattr(f, name)(other).alias("x"), st.predicates[name]("g", other).alias("y"), getattr(f, name)(shapes[7]).alias("c"), st.predicates[name]("g", st.literal(shapes[7])).alias("d")).collect()
        assert [(bool(r.x), bool(r.c)) for r in rows] == [(r.y, r.d) for r in rows], name


def test_partial_unions_of_many_keys_are_passed_on(spark, monkeypatch):
    import tesselon.kernels.geometry as G
    from tesselon.kernels import topology as T

    monkeypatch.setattr(aggregate, "HELD_BYTES", 300)
    monkeypatch.setattr(aggregate, "CHUNK", 2)
    monkeypatch.setattr(aggregate, "FAN", 2)
    rows = [(k % 7, G.to_wkb(G.box(k, 0, k + 1, 1))) for k in range(70)]
    df = spark.createDataFrame(rows, "k int, geometry binary").coalesce(1)
    parts = aggregate.partial_unions(df, ["k"], "geometry").collect()
    assert len(parts) > 7
    assert all(len(T.union_all([G.from_wkb(bytes(r.geometry)) for r in parts if r.k == k]).parts()) == 10 for k in range(7))


def test_a_key_of_many_geometries_is_united_in_tiers(monkeypatch):
    import tesselon.kernels.geometry as G
    from tesselon.kernels import topology as T

    seen = []
    unite = T.union_all
    monkeypatch.setattr(T, "union_all", lambda g: seen.append(len(g)) or unite(g))
    tiers = aggregate.Tiers()
    n = 512 * 20 + 7
    for k in range(n):
        tiers.add(G.box(2 * k, 0, 2 * k + 1, 1))
    assert len(tiers.union().parts()) == n
    # 20 unions of 512, two of eight unions, and what is left at the end.
    assert sorted(seen) == [8, 8, 2 + 4 + 7] + [512] * 20
