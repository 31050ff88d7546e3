import json
import os
import sqlite3
import struct

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesselon.kernels import geometry as G
from tesselon.operators.frame import GeoFrame, boxes_from_bounds, points_from_xy
from tesselon.sources.geofeather import read_feather
from tesselon.sources.geoparquet import read_parquet
from tesselon.sources.vector import read_file


@pytest.fixture(scope="module")
def frame(spark):
    rows = [{"i": i, "k": "ab"[i % 2], "geometry": G.point(i, i) if i % 3 else None} for i in range(12)]
    g = GeoFrame.from_local(spark, rows, crs="EPSG:4326", npartitions=3)
    return g.assign(half=F.col("i") / 2)


def rows(f):
    return sorted((r.i, r.k, None if r.geometry is None else bytes(r.geometry)) for r in f.df.collect())


def test_parquet_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "pq")
    frame.to_parquet(path)
    files = sorted(os.listdir(path))
    assert all(f.startswith("part.") for f in files) and len(files) == 3
    geo = json.loads(pq.read_schema(f"{path}/{files[0]}").metadata[b"geo"])
    assert geo["primary_column"] == "geometry" and len(geo["columns"]["geometry"]["bbox"]) == 4 and geo["columns"]["geometry"]["crs"] == "EPSG:4326"
    back = read_parquet(spark, path)
    assert rows(back) == rows(frame) and back.crs == "EPSG:4326" and back.spatial_partitions.count() == 3
    assert not isinstance(read_parquet(spark, path, columns=["i"]), GeoFrame)
    assert len(read_parquet(spark, path, filters=[("i", ">", 8)])) == 3
    assert len(read_parquet(spark, path, filters=[[("i", "<", 2)], [("i", "==", 7), ("k", "==", "b")]])) == 3
    plan = back.cx[2:4, 2:4].df._jdf.queryExecution().executedPlan().toString()
    assert "geometry__bbox.xmin" in plan.split("PushedFilters")[1]
    with pytest.raises(ValueError, match="exists already"):
        frame.to_parquet(path)
    frame.filter("i < 3").to_parquet(path, mode="overwrite")
    assert len(read_parquet(spark, path)) == 3
    frame.filter("i >= 3").to_parquet(path, mode="append")
    assert rows(read_parquet(spark, path)) == rows(frame)


def test_parquet_hive_missing_and_default_crs(spark, frame, tmp_path):
    path = str(tmp_path / "hive")
    frame.to_parquet(path, partition_on="k")
    assert sorted(os.listdir(path)) == ["k=a", "k=b"] and rows(read_parquet(spark, path)) == rows(frame)
    plain = str(tmp_path / "plain")
    frame.df.write.parquet(plain)
    with pytest.raises(ValueError, match="Missing geo metadata"):
        read_parquet(spark, plain)
    t = pq.read_table(f"{path}/k=a")
    geo = json.loads(pq.read_schema(next(str(p) for p in (tmp_path / "hive" / "k=a").glob("*.parquet"))).metadata[b"geo"])
    for crs, want in ((..., "OGC:CRS84"), (None, None)):
        del geo["columns"]["geometry"]["crs"]
        if crs is None:
            geo["columns"]["geometry"]["crs"] = None
        one = tmp_path / f"one{want is None}.parquet"
        pq.write_table(t.replace_schema_metadata({b"geo": json.dumps(geo).encode()}), one)
        assert read_parquet(spark, str(one)).crs == want
        geo["columns"]["geometry"]["crs"] = "x"
        geo["columns"]["geometry"].pop("bbox", None)
    assert read_parquet(spark, str(one)).spatial_partitions is None


def test_feather_round_trip(spark, frame, tmp_path):
    path = str(tmp_path / "fe")
    write = frame.to_feather(path, compute=False)
    assert not os.path.exists(path)
    write()
    assert sorted(os.listdir(path)) == ["part.0.feather", "part.1.feather", "part.2.feather"]
    back = read_feather(spark, path)
    assert rows(back) == rows(frame) and back.npartitions == 3 and back.crs == "EPSG:4326" and back.spatial_partitions.count() == 3
    assert len(read_feather(spark, path, filters=[("i", "in", [1, 2])], columns=["k", "geometry"])) == 2
    assert read_feather(spark, path, columns=["i"]).columns == ["i"] and "__row_id" in read_feather(spark, path, index="i").df.columns
    with pytest.raises(ValueError, match="not found"):
        read_feather(spark, path, columns=["nope"])
    with pytest.raises(NotImplementedError):
        read_feather(spark, path, index=False)
    with pytest.raises(ValueError, match="No dataset parts"):
        read_feather(spark, str(tmp_path / "none"))


@pytest.fixture
def geojson(tmp_path):
    features = [{"type": "Feature", "properties": {"n": i, "name": f"f{i}", "v": i / 2}, "geometry": {"type": "Point", "coordinates": [i, -i]} if i else None} for i in range(10)]
    p = tmp_path / "x.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(p)


def test_geojson_ranges(spark, geojson):
    g = read_file(spark, geojson, npartitions=3)
    assert g.npartitions == 3 and [r.n for r in g.df.orderBy("__row_id").collect()] == list(range(10)) and g.crs == "OGC:CRS84"
    assert read_file(spark, geojson, chunksize=4).npartitions == 3
    assert read_file(spark, geojson, chunksize=4, columns=["n"]).columns == ["n", "__row_id"]
    for kw in ({}, {"npartitions": 1, "chunksize": 1}, {"npartitions": 1, "skip_features": 1}, {"npartitions": 1, "what": 1}, {"npartitions": 1, "columns": ["z"]}):
        with pytest.raises(ValueError):
            read_file(spark, geojson, **kw)


def test_geopackage_layers(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    db = sqlite3.connect(path)
    db.execute("create table gpkg_contents (table_name text, data_type text)")
    db.execute("create table gpkg_geometry_columns (table_name text, column_name text, srs_id int)")
    for layer, g in (("pts", G.point(1, 2)), ("polys", G.box(0, 0, 1, 1))):
        db.execute("insert into gpkg_contents values (?, 'features')", (layer,))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', 4326)", (layer,))
        db.execute(f"create table {layer} (fid integer primary key, geom blob, col integer)")
        blob = b"GP\x00\x01" + struct.pack("<i", 4326) + G.to_wkb(g)
        db.executemany(f"insert into {layer} (geom, col) values (?, ?)", [(blob, i) for i in range(4)])
    db.commit()
    db.close()
    for layer, kind in ((None, "Point"), ("polys", "Polygon"), (1, "Polygon")):
        g = read_file(spark, path, npartitions=2, layer=layer)
        assert g.crs == "EPSG:4326" and {r.t for r in g.df.select(g.geom_type.alias("t")).collect()} == {kind} and g.df.agg(F.sum("col")).first()[0] == 6
    with pytest.raises(ValueError):
        read_file(spark, path, npartitions=2, layer="nope")


def test_shapefile(spark, tmp_path):
    base = tmp_path / "s"
    shapes = []
    for i in range(5):
        outer = [(i, 0.0), (i, 3.0), (i + 3.0, 3.0), (i + 3.0, 0.0), (i, 0.0)]
        hole = [(i + 1.0, 1.0), (i + 2.0, 1.0), (i + 2.0, 2.0), (i + 1.0, 2.0), (i + 1.0, 1.0)]
        pts = outer + hole
        shapes.append(struct.pack("<i4d2i2i", 5, i, 0, i + 3, 3, 2, 10, 0, 5) + b"".join(struct.pack("<2d", *p) for p in pts))
    shp, shx, at = b"", b"", 50
    for k, s in enumerate(shapes, 1):
        shp += struct.pack(">2i", k, len(s) // 2) + s
        shx += struct.pack(">2i", at, len(s) // 2)
        at += 4 + len(s) // 2
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + shp)
    (tmp_path / "s.shx").write_bytes(b"\0" * 100 + shx)
    field = lambda n, k, w, d: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w, d]) + b"\0" * 14
    head = b"\x03" + b"\0" * 3 + struct.pack("<IHH", 5, 32 + 64 + 1, 1 + 10 + 8) + b"\0" * 20 + field("name", "C", 10, 0) + field("pop", "N", 8, 0) + b"\r"
    (tmp_path / "s.dbf").write_bytes(head + b"".join(b" " + f"n{i}".encode().ljust(10) + str(i).encode().rjust(8) for i in range(5)))
    (tmp_path / "s.prj").write_text('GEOGCS["GCS_WGS_1984"]')
    g = read_file(spark, f"{base}.shp", npartitions=2)
    assert [(r.name, r.pop, r.a) for r in g.df.select("name", "pop", g.area.alias("a")).orderBy("pop").collect()] == [(f"n{i}", i, 8.0) for i in range(5)]
    assert g.crs == "EPSG:4326"
    with pytest.raises(ValueError):
        read_file(spark, "x.kml", npartitions=1)


def test_slices_clips_and_joins_leave_files_out(spark, tmp_path):
    """Files in two places: what meets one place only reads the files there, and hive columns stay."""
    rows = [(i, float(i % 10), float(i % 7), i // 50) for i in range(100)] + [(i, 1000.0 + i % 10, float(i % 7), 2) for i in range(100, 150)]
    p = points_from_xy(spark.createDataFrame(rows, "i int, x double, y double, part int"))
    p.to_parquet(f"{tmp_path}/all", partition_on="part")
    g = read_parquet(spark, f"{tmp_path}/all")
    everything = len(g.df.inputFiles())
    near = g.cx[995:1100, :]
    assert 0 < len(near.df.inputFiles()) < everything
    assert sorted((r.i, r.part) for r in near.df.collect()) == [(i, 2) for i in range(100, 150)]
    cut = g.clip("POLYGON ((-5 -5, 50 -5, 50 50, -5 50, -5 -5))")
    assert len(cut.df.inputFiles()) < everything and cut.df.count() == 100
    assert g.cx[5000:6000, :].df.count() == 0
    boxes_from_bounds(spark.createDataFrame([(0, 1000.0, 0.0, 1003.0, 9.0)], "j int, x0 double, y0 double, x1 double, y1 double"), "x0", "y0", "x1", "y1").to_parquet(f"{tmp_path}/boxes")
    b = read_parquet(spark, f"{tmp_path}/boxes")
    want = sorted(i for i, x, y, _ in rows if 1000 <= x <= 1003)
    for how in ("inner", "semi", "left"):
        out = g.sjoin(b, how=how, predicate="intersects").df
        assert sorted(r.i for r in out.collect() if how != "left" or r.j is not None) == want
        assert how == "left" or len(out.inputFiles()) < everything + 1
    assert g.sjoin(b, how="left").df.count() == 150


def test_slices_of_feather_leave_files_out(spark, tmp_path):
    p = points_from_xy(spark.createDataFrame([(i, float(i), 0.0) for i in range(100)], "i int, x double, y double").repartitionByRange(5, "i"))
    p.to_feather(f"{tmp_path}/f")
    g = read_feather(spark, f"{tmp_path}/f")
    assert len(g.files.boxes) == 5 and len(g.within_reach([(90, 0, 95, 0)]).files.boxes) < 3
    assert sorted(r.i for r in g.cx[90:95, :].df.collect()) == list(range(90, 96))


def test_storage_options_go_to_the_file_system_of_the_scheme(monkeypatch, tmp_path):
    import pyarrow.fs as pafs

    from tesselon.sources import arrowfiles

    seen = []
    monkeypatch.setattr(pafs, "S3FileSystem", lambda **kw: seen.append(kw) or pafs.LocalFileSystem())
    fs, path = arrowfiles.filesystem("s3://bucket/some/file", {"region": "here", "anonymous": True})
    assert seen == [{"region": "here", "anonymous": True}] and path == "bucket/some/file"
    with pytest.raises(ValueError):
        arrowfiles.filesystem(str(tmp_path), {"region": "here"})


def test_a_failed_overwrite_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/kept"
    p = points_from_xy(spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "i int, x double, y double"))
    p.to_parquet(path)
    bad = p.assign(i=F.when(F.col("i") == 7, F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("i")))
    with pytest.raises(Exception, match="stop"):
        bad.to_parquet(path, mode="overwrite")
    assert read_parquet(spark, path).df.count() == 10
    # Reading from the place that is written to works as well.
    half = read_parquet(spark, path)
    half.filter("i < 5").to_parquet(path, mode="overwrite")
    assert sorted(r.i for r in read_parquet(spark, path).df.collect()) == list(range(5))
