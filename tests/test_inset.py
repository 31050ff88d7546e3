"""Buffers inwards of convex polygons, computed together, against the kernel and in number."""

import math
import random
import time

import duckdb
import pytest

from tesselon.functions import st
from tesselon.kernels import columns as K
from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.kernels import topology as T
from tesselon.plans.queries import oracle_sql, queries


def convex(n):
    rnd = random.Random(5)
    for _ in range(n):
        angles, r, x, y = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(rnd.randint(3, 7))), rnd.uniform(0.5, 4), rnd.uniform(-100, 100), rnd.uniform(-50, 50)
        ring = [(x + r * math.cos(t), y + 0.6 * r * math.sin(t)) for t in angles]
        yield G.polygon(ring[::-1] if rnd.random() < 0.3 else ring)


@pytest.mark.parametrize("r", [0.3, 2.0])
def test_insets_equal_the_kernel(r):
    geoms = [*convex(60), G.box(0, 0, 9, 5), G.box(0, 0, 0.5, 5)]
    out, left = K.inset([G.to_wkb(g) for g in geoms], r)
    assert not left
    for i, (wkb, *box) in out.items():
        got, want = G.from_wkb(wkb), T.buffer(geoms[i], -r)
        assert M.area(got) == pytest.approx(M.area(want), abs=1e-9) and got.is_empty == want.is_empty and T.is_valid(got)
        assert box == [None] * 4 if got.is_empty else box == pytest.approx(want.bounds(), abs=1e-9)


def test_other_shapes_are_left_to_the_kernel(spark):
    star = [(3 * math.cos(0.8 * math.pi * k), 3 * math.sin(0.8 * math.pi * k)) for k in range(5)]
    texts = ["POLYGON ((0 0, 4 0, 1 1, 0 4, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (4 4, 5 4, 5 5, 4 5, 4 4))", "POINT (1 2)", "POLYGON EMPTY", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)))"]
    geoms = [*map(G.from_wkt, texts), G.polygon(star)]
    values = [*map(G.to_wkb, geoms), None]
    assert K.inset(values, 0.5) == ({}, list(range(len(geoms))))
    df = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, g binary")
    for row in df.select("i", st.buffer("g", -0.5)["wkb"].alias("b")).collect():
        assert row.b is None if row.i == len(geoms) else bytes(row.b) == G.to_wkb(T.buffer(geoms[row.i], -0.5))


def test_buffers_inwards_of_many_boxes(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.monotonic()
    got = sorted(tuple(r) for r in queries()["buffer_inwards"](spark, str(tmp_path)).select("s_suppkey", "area").collect())
    assert time.monotonic() - began < 60
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    assert got == sorted(con.sql(f"select s_suppkey, area from ({oracle_sql()['buffer_inwards']})").fetchall()) and len(got) > 15_000
