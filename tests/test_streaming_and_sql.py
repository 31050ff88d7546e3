from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.kernels import geometry as G
from tesselon.operators.frame import GeoFrame
from tesselon.streaming.stateless import join_static, stream_points, windowed_counts


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def test_streams(spark, tmp_path):
    rows = [(i, float(i % 10), float(i % 7), f"2024-01-01 00:{i % 60:02d}:00") for i in range(70)]
    df = spark.createDataFrame(rows, "i int, x double, y double, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(f"{tmp_path}/in")
    stream = stream_points(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "x", "y")
    boxes = GeoFrame.from_local(spark, [{"name": "low", "geometry": G.box(0, 0, 5, 5)}, {"name": "high", "geometry": G.box(5, 0, 9, 7)}])
    got = run(spark, join_static(stream, boxes, 10.0).select("i", "name"), "joined", "append")
    want = {(i, n) for i, x, y, _ in rows for n, (a, b, c, d) in (("low", (0, 0, 5, 5)), ("high", (5, 0, 9, 7))) if a < x < c and b < y < d}
    assert {(r.i, r.name) for r in got} == want
    counts = run(spark, windowed_counts(stream, "t", "10 minutes", "30 minutes", [], (0, 0, 10, 10), 2), "counts", "complete")
    assert sum(r["count"] for r in counts) == 70


def test_sql_functions(spark):
    assert "st_area" in st.register(spark)
    r = spark.sql("select st_area(st_geomfromwkt('POLYGON((0 0,2 0,2 2,0 2,0 0))')) a, st_within(st_geomfromwkt('POINT(1 1)'), st_geomfromwkt('POLYGON((0 0,2 0,2 2,0 2,0 0))')) w, st_aswkt(st_centroid(st_geomfromwkt('LINESTRING(0 0,2 0)'))) c").first()
    assert (r.a, r.w, r.c) == (4.0, True, "POINT (1 0)")


def test_dump_gives_a_row_a_part(spark):
    st.register(spark)
    spark.createDataFrame([(0, "MULTIPOINT ((0 0), (1 1), (2 2))"), (1, "POINT EMPTY"), (2, None), (3, "LINESTRING (0 0, 1 1)")], "i int, w string").createOrReplaceTempView("shapes")
    rows = spark.sql("SELECT i, d.part, st_aswkt(d.geometry) AS w FROM shapes, LATERAL st_dump(st_geomfromwkt(w)) d ORDER BY i, part").collect()
    assert [(r.i, r.part, r.w) for r in rows] == [(0, 0, "POINT (0 0)"), (0, 1, "POINT (1 1)"), (0, 2, "POINT (2 2)"), (3, 0, "LINESTRING (0 0, 1 1)")]
    html = GeoFrame.from_local(spark, [{"name": "<a>", "geometry": G.point(0, 0)}])._repr_html_()
    assert "<table" in html and "geometry" in html and "__bbox" not in html
