"""Unions of many geometries: parts that meet no other stay as they are, and large unions travel in pieces."""

import random
import time

import duckdb
import numpy as np
import pytest

from tesselon.kernels import columns as K
from tesselon.kernels import geometry as G
from tesselon.kernels import measures as M
from tesselon.kernels import topology as T
from tesselon.kernels import unions as U
from tesselon.operators import aggregate
from tesselon.operators.frame import from_wkb
from tesselon.plans.queries import oracle_sql, queries


def mixed(rnd):
    x, y, k = rnd.randint(0, 20), rnd.randint(0, 20), rnd.random()
    if k < 0.5:
        return G.box(x, y, x + rnd.randint(1, 4), y + rnd.randint(1, 4))
    texts = [
        f"POINT ({x} {y})", f"LINESTRING ({x} {y}, {x + 3} {y + 2}, {x} {y + 2}, {x + 2} {y})", "POLYGON EMPTY", "MULTIPOLYGON EMPTY",
        f"POLYGON (({x} {y}, {x + 9} {y}, {x + 9} {y + 9}, {x} {y + 9}, {x} {y}), ({x + 1} {y + 1}, {x + 2} {y + 1}, {x + 2} {y + 2}, {x + 1} {y + 1}))",
        f"MULTIPOLYGON ((({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y})), (({x + 5} {y}, {x + 6} {y}, {x + 6} {y + 1}, {x + 5} {y + 3}, {x + 5} {y})))",
        f"GEOMETRYCOLLECTION (POINT (50 {y}), POLYGON Z ((30 30 1, 31 30 1, 31 31 1, 30 30 1)))",
    ]
    return G.from_wkt(rnd.choice(texts))


def test_unions_of_bytes_equal_the_kernel(monkeypatch):
    monkeypatch.setattr(U, "SMALL", 0)
    rnd = random.Random(1)
    for _ in range(60):
        geoms = [mixed(rnd) for _ in range(rnd.randint(1, 14))]
        want, values = T.union_all(geoms), [G.to_wkb(g) for g in geoms]
        assert U.unite(values) == (G.to_wkb(want), *(want.bounds() or (None,) * 4))
        pieces = U.pieces(values, 200)
        assert [p for b in pieces for p in G.from_wkb(b).parts()] == want.parts()


@pytest.mark.parametrize("pairs", [7, 1 << 22])
def test_clusters_are_those_of_chains_of_boxes(monkeypatch, pairs):
    monkeypatch.setattr(K, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    for _ in range(80):
        lo = rng.integers(0, rng.integers(5, 40), (rng.integers(1, 60), 2)).astype(float)
        boxes = np.concatenate([lo, lo + rng.integers(0, rng.integers(2, 7), lo.shape)], 1)
        meet = (boxes[:, None, :2] <= boxes[None, :, 2:]).all(2) & (boxes[None, :, :2] <= boxes[:, None, 2:]).all(2)
        while (more := (meet.astype(int) @ meet.astype(int)) > 0).sum() > meet.sum():
            meet = more
        label = K.clusters(boxes)
        assert ((label[:, None] == label[None, :]) == meet).all()


def test_large_unions_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "PIECE_BYTES", 500)
    rows = [(k % 3, G.to_wkb(G.box(2 * k, 0, 2 * k + 1 + k % 2, 1))) for k in range(600)]
    df = spark.createDataFrame(rows, "k int, geometry binary")
    parts = aggregate.partial_unions(df, ["k"], "geometry").collect()
    assert len(parts) > 60 and max(len(r.geometry) for r in parts) < 700
    united = from_wkb(df, "geometry").dissolve("k")
    for r in united.df.select("k", "geometry").collect():
        assert bytes(r.geometry) == G.to_wkb(T.union_all([G.from_wkb(b) for k, b in rows if k == r.k]))


def test_groups_without_geometries(spark):
    rows = [(1, None, 1), (None, G.to_wkb(G.box(0, 0, 1, 1)), 2), (2, G.to_wkb(G.from_wkt("POLYGON EMPTY")), 3), (None, G.to_wkb(G.box(1, 0, 2, 1)), 4)]
    g = from_wkb(spark.createDataFrame(rows, "k bigint, geometry binary, v int"), "geometry")
    d = g.dissolve("k", "sum", dropna=False)
    assert sorted(map(tuple, d.df.select("k", "v", d.area.alias("a")).collect()), key=str) == [(1, 1, None), (2, 3, 0.0), (None, 6, 2.0)]
    nulls = g.filter("k = 1")
    assert [(r.v, r.geometry) for r in nulls.dissolve(None, "sum").df.collect()] == [(1, None)]
    for f in (nulls, g.filter("v > 9")):
        assert [G.from_wkb(bytes(r.geometry)) for r in f.union_all().collect()] == [G.EMPTY]
    assert g.filter("v > 9").dissolve(None, "sum").df.count() == 0


def check_many_tiles(spark, path, name):
    spark.range(200_000).selectExpr("id AS c_custkey", "0 AS c_nationkey", "CAST(id % 97 AS DOUBLE) AS c_acctbal").coalesce(1).write.parquet(f"{path}/customer.parquet")
    began = time.monotonic()
    df = queries()[name](spark, str(path))
    got = [tuple(r) for r in df.collect()]
    assert time.monotonic() - began < 60
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{path}/customer.parquet/*.parquet'")
    assert got == con.sql(f"select {', '.join(df.columns)} from ({oracle_sql()[name]})").fetchall()


def test_dissolve_of_many_tiles(spark, tmp_path):
    check_many_tiles(spark, tmp_path, "dissolve_all")


def test_union_of_many_tiles(spark, tmp_path):
    check_many_tiles(spark, tmp_path, "union_all_area")


def test_areas_of_multipolygons_are_computed_together():
    rnd = random.Random(2)
    square, holed, z = G.box(0, 0, 2, 1), G.from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), G.from_wkt("POLYGON Z ((0 0 1, 1 0 1, 1 1 1, 0 0 1))")
    geoms = [G.Geom(G.MULTIPOLYGON, [G.box(x, 0, x + rnd.random(), 3) for x in range(9)]), G.Geom(G.MULTIPOLYGON, [square, holed, G.Geom(G.POLYGON, [])]), G.Geom(G.MULTIPOLYGON, []), holed, z, G.collect([square, z])]
    values = [*map(G.to_wkb, geoms), G.to_wkb(geoms[0])[:-16], None]
    out, left = K.area(values)
    assert left.tolist() == [3, 4, 5, 6]
    assert out[:3].tolist() == pytest.approx([M.area(g) for g in geoms[:3]], rel=1e-12)
