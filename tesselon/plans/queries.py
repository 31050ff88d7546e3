"""Queries of the engine over the driver's tables, whose geometries derive from integer keys.

Points come from ``customer``, boxes from ``supplier``, boxes on a coarse integer grid (for boundary
cases) from ``supplier`` and ``nation``, triangles from ``part``, two-point lines from ``orders``.
Each query has SQL that computes the same rows by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.functions import st
from tesselon.operators.frame import GeoFrame, boxes_from_bounds, concat, from_wkb, from_wkt, points_from_xy, shared_folder
from tesselon.operators.partition import spatial_shuffle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lon(k: str) -> str:
    return f"(CAST(({k} * 7919) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE))"


def lat(k: str) -> str:
    return f"(CAST(({k} * 104729) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE))"


POINTS = f"SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, {lon('c_custkey')} AS x, {lat('c_custkey')} AS y FROM customer"
BOXES = (
    f"SELECT s_suppkey, s_nationkey, {lon('s_suppkey')} AS x0, {lat('s_suppkey')} AS y0, {lon('s_suppkey')} + CAST(1 + s_nationkey % 10 AS DOUBLE) AS x1, "
    f"{lat('s_suppkey')} + CAST(1 + s_nationkey % 10 AS DOUBLE) AS y1 FROM supplier"
)
_GRID = "CAST({k} * {a} % 20 AS DOUBLE) AS x0, CAST({k} * {b} % 20 AS DOUBLE) AS y0, CAST({k} * {a} % 20 + 1 + {k} % {w} AS DOUBLE) AS x1, CAST({k} * {b} % 20 + 1 + {k} % {h} AS DOUBLE) AS y1"
GRID_A = f"SELECT s_suppkey, {_GRID.format(k='s_suppkey', a=7, b=13, w=4, h=3)} FROM supplier"
GRID_B = f"SELECT n_nationkey, {_GRID.format(k='n_nationkey', a=3, b=11, w=5, h=6)} FROM nation"
LINES = f"SELECT o_orderkey, {lon('o_orderkey')} AS x0, {lat('o_orderkey')} AS y0, {lon('o_custkey')} AS x1, {lat('o_custkey')} AS y1 FROM orders"
TRIANGLES = f"SELECT p_partkey, p_size, p_brand, {lon('p_partkey')} AS x, {lat('p_partkey')} AS y, CAST(1 + p_size % 5 AS DOUBLE) AS w, CAST(1 + p_size % 7 AS DOUBLE) AS h FROM part"


def _sql(spark: SparkSession, d: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f" FROM {name}", " FROM {t}"), t=table(spark, d, name))


def points(spark, d) -> GeoFrame:
    return points_from_xy(_sql(spark, d, POINTS, "customer"), crs="EPSG:4326")


def boxes(spark, d) -> GeoFrame:
    return boxes_from_bounds(_sql(spark, d, BOXES, "supplier"), "x0", "y0", "x1", "y1")


def polygons(frame: GeoFrame) -> GeoFrame:
    """The same boxes as polygons of no known shape, so that relations run in the kernel."""
    return from_wkb(frame.df.drop("geometry__bbox"), "geometry")


def grid_a(spark, d) -> GeoFrame:
    return boxes_from_bounds(_sql(spark, d, GRID_A, "supplier"), "x0", "y0", "x1", "y1")


def grid_b(spark, d) -> GeoFrame:
    return boxes_from_bounds(_sql(spark, d, GRID_B, "nation"), "x0", "y0", "x1", "y1")


def _wkt(template: str) -> Column:
    """Text with {column} places filled from columns."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def lines(spark, d) -> GeoFrame:
    df = _sql(spark, d, LINES, "orders")
    return from_wkt(df.withColumn("w", _wkt("LINESTRING ({x0} {y0}, {x1} {y1})")), "w")


def triangles(spark, d) -> GeoFrame:
    df = _sql(spark, d, TRIANGLES, "part").withColumns({"x2": F.expr("x + w"), "y2": F.expr("y + h")})
    return from_wkt(df.withColumn("t", _wkt("POLYGON (({x} {y}, {x2} {y}, {x} {y2}, {x} {y}))")), "t")


# Selection

@query(f"SELECT c_mktsegment, count(*) AS n FROM ({POINTS}) WHERE x > -60 AND x < 60 AND y > -30 AND y < 30 GROUP BY c_mktsegment")
def points_within_box(spark, d):
    p = points(spark, d)
    return p.filter(p.within("POLYGON ((-60 -30, 60 -30, 60 30, -60 30, -60 -30))")).df.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey FROM ({POINTS}) WHERE x BETWEEN -10 AND 40 AND y BETWEEN -20 AND 35")
def cx_slice(spark, d):
    return points(spark, d).cx[-10:40, 35:-20].df.select("c_custkey")


@query(f"SELECT s_suppkey FROM ({BOXES}) WHERE x0 <= 50 AND x1 >= -50 AND y1 >= 0")
def cx_polygons(spark, d):
    return polygons(boxes(spark, d)).cx[-50:50, 0:].df.select("s_suppkey")


@query(f"SELECT s_suppkey, round((least(x1, 100) - greatest(x0, -100)) * (least(y1, 60) - greatest(y0, -60)), 6) AS area FROM ({BOXES}) WHERE x0 < 100 AND x1 > -100 AND y0 < 60 AND y1 > -60")
def clip_box(spark, d):
    c = polygons(boxes(spark, d)).clip("POLYGON ((-100 -60, 100 -60, 100 60, -100 60, -100 -60))", keep_geom_type=True)
    return c.df.select("s_suppkey", F.round(c.area, 6).alias("area"))


# Joins

_MEET = "p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1"
_INNER = "p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1"
_IN = "q.x0 <= p.x0 AND p.x1 <= q.x1 AND q.y0 <= p.y0 AND p.y1 <= q.y1"
_HAS = "p.x0 <= q.x0 AND q.x1 <= p.x1 AND p.y0 <= q.y0 AND q.y1 <= p.y1"
_PAIRS = {
    "intersects": _MEET,
    "touches": f"{_MEET} AND NOT ({_INNER})",
    "overlaps": f"{_INNER} AND NOT ({_IN}) AND NOT ({_HAS})",
    "within": _IN,
    "covered_by": _IN,
    "contains": _HAS,
    "covers": _HAS,
    "contains_properly": "p.x0 < q.x0 AND q.x1 < p.x1 AND p.y0 < q.y0 AND q.y1 < p.y1",
}


def _pair_query(name: str):
    def f(spark, d):
        return polygons(grid_a(spark, d)).sjoin(polygons(grid_b(spark, d)), predicate=name).df.select("s_suppkey", "n_nationkey")

    f.__name__ = f"sjoin_{name}"
    query(f"SELECT s_suppkey, n_nationkey FROM ({GRID_A}) p, ({GRID_B}) q WHERE {_PAIRS[name]}")(f)


for _name in _PAIRS:
    _pair_query(_name)


@query(f"SELECT c_custkey, s_suppkey FROM ({POINTS}) p, ({BOXES}) q WHERE x > x0 AND x < x1 AND y > y0 AND y < y1")
def sjoin_points_within_boxes(spark, d):
    return points(spark, d).sjoin(boxes(spark, d), predicate="within").df.select("c_custkey", "s_suppkey")


@query(f"SELECT s_suppkey, count(*) AS n FROM ({POINTS}) p, ({BOXES}) q WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY s_suppkey")
def sjoin_boxes_cover_points(spark, d):
    return boxes(spark, d).sjoin(points(spark, d), predicate="covers").df.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query(
    f"SELECT n_nationkey AS line, s_suppkey FROM (SELECT n_nationkey, x0 AS a, x0 + 5 AS b, y0 + CAST(0.5 AS DOUBLE) AS y FROM ({GRID_B})) l, ({GRID_A}) q "
    "WHERE y > y0 AND y < y1 AND a < x1 AND b > x0 AND NOT (a >= x0 AND b <= x1)"
)
def sjoin_lines_cross_boxes(spark, d):
    l = _sql(spark, d, GRID_B, "nation").selectExpr("n_nationkey AS line", "x0 AS a", "x0 + 5 AS b", "y0 + 0.5D AS y")
    l = from_wkt(l.withColumn("w", _wkt("LINESTRING ({a} {y}, {b} {y})")), "w")
    return l.sjoin(polygons(grid_a(spark, d)), predicate="crosses").df.select("line", "s_suppkey")


@query(f"SELECT s_suppkey, n_nationkey FROM ({GRID_A}) p LEFT JOIN ({GRID_B}) q ON {_MEET}")
def sjoin_left(spark, d):
    return grid_a(spark, d).sjoin(grid_b(spark, d), how="left").df.select("s_suppkey", "n_nationkey")


@query(f"SELECT s_suppkey FROM ({GRID_A}) p WHERE EXISTS (SELECT 1 FROM ({GRID_B}) q WHERE {_MEET})")
def sjoin_semi(spark, d):
    return grid_a(spark, d).sjoin(grid_b(spark, d), how="semi").df.select("s_suppkey")


@query(f"SELECT s_suppkey FROM ({GRID_A}) p WHERE NOT EXISTS (SELECT 1 FROM ({GRID_B}) q WHERE {_MEET})")
def sjoin_anti(spark, d):
    return grid_a(spark, d).sjoin(grid_b(spark, d), how="anti").df.select("s_suppkey")


@query(f"SELECT n_name, count(*) AS n, round(max(x), 6) AS east FROM ({POINTS}) p JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def merge_attributes(spark, d):
    p = points(spark, d)
    j = p.df.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.max("geometry__bbox.xmax"), 6).alias("east"))


@query(f"SELECT count(*) AS n, min(x) AS west FROM (SELECT x FROM ({POINTS}) UNION ALL SELECT x FROM ({POINTS}))")
def concat_frames(spark, d):
    c = concat([points(spark, d), points(spark, d)])
    return c.df.agg(F.count("*").alias("n"), F.min("geometry__bbox.xmin").alias("west"))


# Measures

@query(f"SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM ({POINTS})")
def total_bounds(spark, d):
    return points(spark, d).total_bounds()


@query(f"SELECT s_suppkey, x0 AS minx, y0 AS miny, x1 AS maxx, y1 AS maxy FROM ({BOXES})")
def bounds(spark, d):
    b = boxes(spark, d)
    return b.df.select("s_suppkey", *b.bounds)


@query(f"SELECT c_nationkey, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM ({POINTS}) GROUP BY c_nationkey")
def partition_extents(spark, d):
    b = points(spark, d).df.select("c_nationkey", "geometry__bbox.*")
    return b.groupBy("c_nationkey").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


@query(f"SELECT p_partkey, round(w * h / 2, 6) AS area, round(w + h + sqrt(w * w + h * h), 6) AS length FROM ({TRIANGLES})")
def area_and_length(spark, d):
    t = triangles(spark, d)
    return t.df.select("p_partkey", F.round(t.area, 6).alias("area"), F.round(t.length, 6).alias("length"))


@query(f"SELECT p_partkey, round(x + w / 3, 6) AS cx, round(y + h / 3, 6) AS cy FROM ({TRIANGLES})")
def centroid(spark, d):
    c = triangles(spark, d).centroid
    return c.df.select("p_partkey", F.round(c.x, 6).alias("cx"), F.round(c.y, 6).alias("cy"))


@query(f"SELECT p_partkey, round(w * h, 6) AS envelope, round(w * h / 2, 6) AS hull FROM ({TRIANGLES})")
def envelope_and_hull(spark, d):
    t = triangles(spark, d)
    return t.df.select("p_partkey", F.round(st.area(st.envelope("geometry")["wkb"]), 6).alias("envelope"), F.round(st.area(st.convex_hull("geometry")["wkb"]), 6).alias("hull"))


@query(f"SELECT p_partkey, round(w + h + sqrt(w * w + h * h), 6) AS boundary, round(w + h + sqrt(w * w + h * h), 6) AS exterior, 0 AS holes FROM ({TRIANGLES})")
def boundary_and_rings(spark, d):
    t = triangles(spark, d)
    return t.df.select(
        "p_partkey", F.round(st.length(st.boundary("geometry")["wkb"]), 6).alias("boundary"), F.round(st.length(st.exterior("geometry")["wkb"]), 6).alias("exterior"), F.size(t.interiors).alias("holes")
    )


@query(f"SELECT p_partkey, true AS inside FROM ({TRIANGLES})")
def representative_point(spark, d):
    r = st.representative_point("geometry")["wkb"]
    return triangles(spark, d).df.select("p_partkey", st.predicates["within"](r, "geometry").alias("inside"))


@query(f"SELECT c_custkey, round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), 6) AS dist FROM ({POINTS})")
def distance_to_point(spark, d):
    p = points(spark, d)
    return p.df.select("c_custkey", F.round(p.distance("POINT (10 20)"), 6).alias("dist"))


@query(f"SELECT c_custkey, round(sqrt(pow(greatest(-20 - x, 0, x - 30), 2) + pow(greatest(-10 - y, 0, y - 40), 2)), 6) AS dist FROM ({POINTS})")
def distance_to_box(spark, d):
    p = points(spark, d)
    return p.df.select("c_custkey", F.round(p.distance("POLYGON ((-20 -10, 30 -10, 30 40, -20 40, -20 -10))"), 6).alias("dist"))


@query("SELECT 'Polygon' AS kind, count(*) AS n, count(*) AS valid, 0::BIGINT AS empty, 0::BIGINT AS z FROM part")
def type_and_validity(spark, d):
    t = triangles(spark, d)
    flag = lambda c: F.sum(c.cast("long"))
    return t.df.groupBy(t.geom_type.alias("kind")).agg(F.count("*").alias("n"), flag(t.is_valid).alias("valid"), flag(t.is_empty).alias("empty"), flag(t.has_z).alias("z"))


@query(f"SELECT count(*) AS n, count(*) AS simple, 0::BIGINT AS ring FROM ({LINES}) WHERE x0 <> x1 OR y0 <> y1")
def lines_simple_and_rings(spark, d):
    l = lines(spark, d).filter("x0 <> x1 OR y0 <> y1")
    return l.df.agg(F.count("*").alias("n"), F.sum(l.is_simple.cast("long")).alias("simple"), F.sum(l.is_ring.cast("long")).alias("ring"))


@query(f"SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS missing, count(*) FILTER (c_custkey % 3 = 0) AS filled FROM ({POINTS})")
def missing_values(spark, d):
    df = points(spark, d).df.withColumn("geometry", F.expr("CASE WHEN c_custkey % 3 <> 0 THEN geometry END"))
    g = from_wkb(df.drop("geometry__bbox"), "geometry")
    f = g.fillna("POINT (999 999)")
    return f.df.join(g.df.select("c_custkey", g.isna().alias("na")), "c_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("na").cast("long")).alias("missing"), F.sum((f.x == 999).cast("long")).alias("filled")
    )


# Constructions

# Adding zero makes a negative zero positive on both sides.
_MOVED = "SELECT c_custkey, round({x}, 6) + 0 AS nx, round({y}, 6) + 0 AS ny FROM ({p})"


def _xy(frame: GeoFrame) -> DataFrame:
    return frame.df.select("c_custkey", (F.round(frame.bbox["xmin"], 6) + 0).alias("nx"), (F.round(frame.bbox["ymin"], 6) + 0).alias("ny"))


@query(_MOVED.format(x="2 * x + y + 3", y="x - y - 4", p=POINTS))
def affine_transform(spark, d):
    return _xy(points(spark, d).affine_transform([2, 1, 1, -1, 3, -4]))


@query(_MOVED.format(x="x + 1.5", y="y - 2.5", p=POINTS))
def translate(spark, d):
    return _xy(points(spark, d).translate(1.5, -2.5))


@query(_MOVED.format(x="-y", y="x", p=POINTS))
def rotate(spark, d):
    return _xy(points(spark, d).rotate(90, origin=(0, 0)))


@query(_MOVED.format(x="1 + (x - 1) * 2", y="1 + (y - 1) * 3", p=POINTS))
def scale(spark, d):
    return _xy(points(spark, d).scale(2, 3, origin=(1, 1)))


@query(_MOVED.format(x="x + tan(radians(30)) * y", y="y", p=POINTS))
def skew(spark, d):
    return _xy(points(spark, d).skew(30, 0, origin=(0, 0)))


@query(_MOVED.format(x="radians(x) * 6378137", y="ln(tan(pi() / 4 + radians(y) / 2)) * 6378137", p=POINTS) + " WHERE abs(y) < 85")
def to_crs_mercator(spark, d):
    return _xy(points(spark, d).filter("abs(y) < 85").to_crs(3857))


@query(f"SELECT o_orderkey, round(x0 + (x1 - x0) / 4, 6) AS px, round(y0 + (y1 - y0) / 4, 6) AS py FROM ({LINES}) WHERE x0 <> x1 OR y0 <> y1")
def interpolate(spark, d):
    i = lines(spark, d).filter("x0 <> x1 OR y0 <> y1").interpolate(0.25, normalized=True)
    return i.df.select("o_orderkey", F.round(i.x, 6).alias("px"), F.round(i.y, 6).alias("py"))


_T = "greatest(0, least(1, ((0 - x0) * (x1 - x0) + (0 - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))))"


@query(f"SELECT o_orderkey, round({_T} * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 5) AS along FROM ({LINES}) WHERE x0 <> x1 OR y0 <> y1")
def project(spark, d):
    l = lines(spark, d).filter("x0 <> x1 OR y0 <> y1")
    return l.df.select("o_orderkey", F.round(l.project("POINT (0 0)"), 5).alias("along"))


@query(f"SELECT c_custkey, round(32 * sin(pi() / 32) * 4, 6) AS area FROM ({POINTS})")
def buffer_points(spark, d):
    b = points(spark, d).buffer(2.0)
    return b.df.select("c_custkey", F.round(b.area, 6).alias("area"))


@query(f"SELECT s_suppkey, round((x1 - x0 - 1) * (y1 - y0 - 1), 6) AS area FROM ({BOXES}) WHERE x1 - x0 > 1.5")
def buffer_inwards(spark, d):
    b = boxes(spark, d).filter("x1 - x0 > 1.5").buffer(-0.5)
    return b.df.select("s_suppkey", F.round(b.area, 6).alias("area"))


@query(f"SELECT p_partkey, 4 AS vertices FROM ({TRIANGLES})")
def simplify(spark, d):
    df = triangles(spark, d).df.drop("geometry", "geometry__bbox").withColumn("m", F.expr("x + w / 2"))
    g = from_wkt(df.withColumn("t2", _wkt("POLYGON (({x} {y}, {m} {y}, {x2} {y}, {x} {y2}, {x} {y}))")), "t2").simplify(0.001)
    return g.df.select("p_partkey", F.expr("length(geometry) - 13").alias("b")).selectExpr("p_partkey", "CAST(b / 16 AS INT) AS vertices")


@query(f"SELECT c_custkey, part, round(x + part, 6) AS px FROM ({POINTS}), (SELECT unnest([0, 1]) AS part)")
def explode_multipoint(spark, d):
    df = points(spark, d).df.select("c_custkey", "x", "y").withColumn("x2", F.expr("x + 1"))
    e = from_wkt(df.withColumn("m", _wkt("MULTIPOINT (({x} {y}), ({x2} {y}))")), "m").explode(index_parts=True)
    return e.df.select("c_custkey", F.col("index_parts").alias("part"), F.round(e.x, 6).alias("px"))


@query("SELECT s_suppkey, 'POINT (' || CAST(s_suppkey * 7 % 20 AS VARCHAR) || ' ' || CAST(s_suppkey * 13 % 20 AS VARCHAR) || ')' AS wkt FROM supplier")
def to_wkt(spark, d):
    g = points_from_xy(_sql(spark, d, GRID_A, "supplier"), "x0", "y0")
    return g.to_wkt().select("s_suppkey", F.col("geometry").alias("wkt"))


@query("SELECT s_suppkey, 42 AS digits, '0101000000' AS head FROM supplier")
def to_wkb_hex(spark, d):
    g = points_from_xy(_sql(spark, d, GRID_A, "supplier"), "x0", "y0")
    return g.to_wkb(hex=True).select("s_suppkey", F.length("geometry").alias("digits"), F.substring("geometry", 1, 10).alias("head"))


@query(
    f"SELECT s_suppkey, CASE WHEN x0 > 5 AND x0 < 12 AND y0 > 5 AND y0 < 12 THEN '0FFFFF212' WHEN x0 >= 5 AND x0 <= 12 AND y0 >= 5 AND y0 <= 12 THEN 'F0FFFF212' ELSE 'FF0FFF212' END AS matrix FROM ({GRID_A})"
)
def relate_point_box(spark, d):
    g = points_from_xy(_sql(spark, d, GRID_A, "supplier"), "x0", "y0")
    return g.df.select("s_suppkey", g.relate("POLYGON ((5 5, 12 5, 12 12, 5 12, 5 5))").alias("matrix"))


@query(f"SELECT s_suppkey, x0 = 5 AND y0 = 5 AND x1 = 7 AND y1 = 7 AS same, abs(x0 - 5) <= 1 AND abs(y0 - 5) <= 1 AND abs(x1 - 7) <= 1 AND abs(y1 - 7) <= 1 AS nearly FROM ({GRID_A})")
def equality(spark, d):
    g = grid_a(spark, d)
    window = "POLYGON ((7 5, 7 7, 5 7, 5 5, 7 5))"
    return g.df.select("s_suppkey", g.geom_equals(window).alias("same"), g.geom_equals_exact(window, 1.0).alias("nearly"))


# Overlays

_A, _W = "(x1 - x0) * (y1 - y0)", "greatest(0, least(x1, 12) - greatest(x0, 4)) * greatest(0, least(y1, 12) - greatest(y0, 4))"


@query(f"SELECT s_suppkey, round({_W}, 6) AS inter, round({_A} + 64 - {_W}, 6) AS uni, round({_A} - {_W}, 6) AS diff, round({_A} + 64 - 2 * {_W}, 6) AS sym FROM ({GRID_A})")
def overlays(spark, d):
    window = st.literal("POLYGON ((4 4, 12 4, 12 12, 4 12, 4 4))")
    g = grid_a(spark, d).df
    names = {"inter": "intersection", "uni": "union", "diff": "difference", "sym": "symmetric_difference"}
    return g.select("s_suppkey", *[F.round(st.area(st.overlays[op]("geometry", window)["wkb"]), 6).alias(n) for n, op in names.items()])


# Aggregation

_TILES = "SELECT c_custkey, c_nationkey, c_acctbal, CAST(c_custkey % 100 * 2 AS DOUBLE) AS x0, CAST(c_custkey // 100 * 2 AS DOUBLE) AS y0 FROM customer"


def tiles(spark, d) -> GeoFrame:
    df = _sql(spark, d, _TILES.replace("//", "DIV"), "customer").withColumns({"x1": F.expr("x0 + 1"), "y1": F.expr("y0 + 1")})
    return boxes_from_bounds(df, "x0", "y0", "x1", "y1").drop(columns=["x0", "y0", "x1", "y1"])


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS balance, CAST(count(*) AS DOUBLE) AS area FROM customer GROUP BY c_nationkey")
def dissolve_sum(spark, d):
    g = tiles(spark, d).dissolve("c_nationkey", {"c_acctbal": "sum"})
    return g.df.select("c_nationkey", F.round("c_acctbal", 2).alias("balance"), F.round(g.area, 6).alias("area"))


@query("SELECT c_nationkey, arg_min(c_acctbal, c_custkey) AS balance, CAST(count(*) AS DOUBLE) AS area FROM customer GROUP BY c_nationkey")
def dissolve_first(spark, d):
    g = tiles(spark, d).rename({"c_custkey": "__row_id"}).dissolve("c_nationkey")
    return g.df.select("c_nationkey", F.col("c_acctbal").alias("balance"), F.round(g.area, 6).alias("area"))


@query("SELECT c_nationkey, max(c_acctbal) AS c_acctbal, count(*) AS c_custkey, CAST(count(*) AS DOUBLE) AS area FROM customer GROUP BY c_nationkey")
def dissolve_dict(spark, d):
    g = tiles(spark, d).dissolve("c_nationkey", {"c_acctbal": "max", "c_custkey": "count"}, large_groups=False)
    return g.df.select("c_nationkey", "c_acctbal", "c_custkey", F.round(g.area, 6).alias("area"))


@query("SELECT max(c_acctbal) AS c_acctbal, CAST(count(*) AS DOUBLE) AS area FROM customer")
def dissolve_all(spark, d):
    g = tiles(spark, d).dissolve(None, {"c_acctbal": "max"})
    return g.df.select("c_acctbal", F.round(g.area, 6).alias("area"))


@query("SELECT CAST(count(*) AS DOUBLE) AS area FROM customer")
def union_all_area(spark, d):
    return tiles(spark, d).union_all().select(F.round(st.area("geometry"), 6).alias("area"))


# Curves

def _cells(level: int) -> str:
    n = 2**level - 1
    cell = lambda v, lo, w: f"CAST(trunc(least(greatest(({v} - ({lo})) * (CAST({n} AS DOUBLE) / {w}), 0), {n})) AS BIGINT)"
    return f"SELECT c_custkey, {cell('x', -180, 360.0)} AS cx, {cell('y', -90, 180.0)} AS cy FROM ({POINTS})"


def _spread_sql(v: str, steps) -> str:
    for shift, mask in steps:
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


_S16 = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _staged(source: str, stages: list[dict[str, str]], last: str) -> str:
    """Nested selects, one per stage, each adding or replacing columns."""
    for s in stages:
        source = f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in s.items())}) FROM ({source})"
    return f"SELECT {last} FROM ({source})"


def _spread_stages(cols: list[str], steps) -> list[dict[str, str]]:
    return [{c: f"(({c} | ({c} << {k})) & {m})" for c in cols} for k, m in steps]


@query(_staged(_cells(16), _spread_stages(["cx", "cy"], _S16), "c_custkey, cx | (cy << 1) AS morton"))
def morton_distance(spark, d):
    return points(spark, d).morton_distance((-180, -90, 180, 90), name="morton").df.select("c_custkey", "morton")


def _hilbert_stages() -> list[dict[str, str]]:
    """The walk down the quadrants, one level a stage: swap and flip are the orientation, u and v the bits in it."""
    out = []
    for k in reversed(range(16)):
        out.append({"u": f"xor((CASE WHEN swap = 1 THEN cy ELSE cx END >> {k}) & 1, flip)", "v": f"xor((CASE WHEN swap = 1 THEN cx ELSE cy END >> {k}) & 1, flip)"})
        out.append({"h": "4 * h + 2 * u + xor(u, v)", "swap": "xor(swap, 1 - v)", "flip": "xor(flip, u * (1 - v))"})
    return out


_H = ", ".join(f"0::BIGINT AS {c}" for c in ("h", "u", "v", "swap", "flip"))


@query(_staged(f"SELECT *, {_H} FROM ({_cells(16)})", _hilbert_stages(), "c_custkey, h AS hilbert"))
def hilbert_distance(spark, d):
    return points(spark, d).hilbert_distance((-180, -90, 180, 90), name="hilbert").df.select("c_custkey", "hilbert")


_S32 = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
_Q = f"SELECT c_custkey, CAST(floor((y + 90) * (CAST(4294967296 AS DOUBLE) / 180)) AS UBIGINT) AS cy, CAST(floor((x + 180) * (CAST(4294967296 AS DOUBLE) / 360)) AS UBIGINT) AS cx FROM ({POINTS})"
_GEOHASH = _staged(_Q, [{c: f"(({c} | ({c} << {k})) & CAST({m} AS UBIGINT))" for c in ("cx", "cy")} for k, m in _S32], "c_custkey, CAST((cy | (cx << 1)) >> 4 AS BIGINT) AS h")


@query(f"SELECT c_custkey, h AS geohash FROM ({_GEOHASH})")
def geohash_int(spark, d):
    return points(spark, d).geohash(as_string=False).df.select("c_custkey", "geohash")


@query(f"SELECT c_custkey, {' || '.join(f'''substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST((h >> {55 - 5 * k}) & 31 AS INT) + 1, 1)''' for k in range(8))} AS geohash FROM ({_GEOHASH})")
def geohash_string(spark, d):
    return points(spark, d).geohash(precision=8).df.select("c_custkey", "geohash")


@query(f"SELECT count(*) AS n, min(x) AS west, max(y) AS north FROM ({POINTS})")
def spatial_shuffle_hilbert(spark, d):
    s = spatial_shuffle(points(spark, d), "hilbert", npartitions=8, calculate_partitions=False)
    return s.df.agg(F.count("*").alias("n"), F.min("geometry__bbox.xmin").alias("west"), F.max("geometry__bbox.ymax").alias("north"))


@query(f"SELECT n_nationkey AS k, c_nationkey, count(*) AS n FROM ({POINTS}) JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def rename_and_set_geometry(spark, d):
    g = points(spark, d).rename_geometry("place").assign(k=F.col("c_nationkey"))
    return g.set_geometry("place").df.groupBy("k", "c_nationkey").agg(F.count("*").alias("n"))


# What frames inherit from Spark, and row-wise functions

@query(f"SELECT s_suppkey, round((x1 - x0) * (y1 - y0), 6) AS area FROM ({BOXES}) ORDER BY area DESC, s_suppkey LIMIT 10")
def nlargest_area(spark, d):
    b = boxes(spark, d)
    return b.df.select("s_suppkey", F.round(b.area, 6).alias("area")).orderBy(F.desc("area"), "s_suppkey").limit(10)


@query(f"SELECT c_mktsegment, c_nationkey, count(*) AS n, round(avg(y), 6) AS north FROM ({POINTS}) GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, d):
    p = points(spark, d)
    return p.df.cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("geometry__bbox.ymin"), 6).alias("north"))


@query(f"SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY y DESC, c_custkey) AS r FROM ({POINTS})) WHERE r <= 2")
def northernmost_per_nation(spark, d):
    from pyspark.sql.window import Window

    p = points(spark, d)
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("geometry__bbox.ymin"), "c_custkey")
    return p.df.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("c_nationkey", "c_custkey")


@query(f"SELECT p_partkey, 4 AS vertices FROM ({TRIANGLES})")
def apply_function(spark, d):
    t = triangles(spark, d)
    return t.df.select("p_partkey", t.apply(lambda g: len(g.coords()), "int").alias("vertices"))


@query(
    f"SELECT coalesce(c_custkey, s_suppkey) AS id, coalesce(x >= x0 AND x <= x1 AND y >= y0 AND y <= y1, false) AS hit FROM ({POINTS}) p FULL OUTER JOIN ({BOXES}) q ON c_custkey = s_suppkey"
)
def aligned_intersects(spark, d):
    p = points(spark, d).rename({"c_custkey": "__row_id"})
    b = boxes(spark, d).rename({"s_suppkey": "__row_id"})
    both = p.align(b)
    return both.df.select(F.col("__row_id").alias("id"), st.predicates["intersects"]("geometry", "geometry_other").alias("hit"))


@query(
    f"SELECT n_nationkey, s_suppkey FROM (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY (p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0), s_suppkey) AS r "
    f"FROM ({GRID_B}) p, ({GRID_A}) q) WHERE r <= 2"
)
def nearest_join(spark, d):
    from tesselon.operators.sjoin import sjoin_nearest

    a = points_from_xy(_sql(spark, d, GRID_B, "nation").withColumnRenamed("n_nationkey", "__row_id"), "x0", "y0")
    b = points_from_xy(_sql(spark, d, GRID_A, "supplier").withColumnRenamed("s_suppkey", "__row_id"), "x0", "y0")
    return sjoin_nearest(a, b, k=2).selectExpr("left_id AS n_nationkey", "right_id AS s_suppkey")


# Files: written to the shared folder, read again

def _shared(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/tesselon-{uuid.uuid4().hex}"


@query(f"SELECT c_custkey, c_mktsegment, x AS px FROM ({POINTS}) WHERE x BETWEEN 0 AND 90")
def geoparquet_round_trip(spark, d):
    from tesselon.sources.geoparquet import read_parquet

    path = _shared(spark)
    points(spark, d).to_parquet(path)
    g = read_parquet(spark, path).cx[0:90, :]
    return g.df.select("c_custkey", "c_mktsegment", g.x.alias("px"))


@query(f"SELECT c_custkey, y AS py FROM ({POINTS}) WHERE c_custkey < 100 OR c_nationkey = 3")
def feather_round_trip(spark, d):
    from tesselon.sources.geofeather import read_feather

    path = _shared(spark)
    points(spark, d).to_feather(path)
    g = read_feather(spark, path, columns=["c_custkey", "geometry"], filters=[[("c_custkey", "<", 100)], [("c_nationkey", "==", 3)]])
    return g.df.select("c_custkey", g.y.alias("py"))


@query("SELECT n_nationkey, n_name FROM nation")
def read_file_rows(spark, d):
    """A vector file written to the shared folder from the 25 rows of ``nation``, and read in ranges."""
    import json

    from tesselon.sources.arrowfiles import filesystem
    from tesselon.sources.vector import read_file

    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    features = [{"type": "Feature", "properties": r.asDict(), "geometry": {"type": "Point", "coordinates": [r.n_nationkey, -r.n_nationkey]}} for r in rows]
    fs, path = filesystem(_shared(spark) + ".geojson")
    with fs.open_output_stream(path) as out:
        out.write(json.dumps({"type": "FeatureCollection", "features": features}).encode())
    f = read_file(spark, path, chunksize=7)
    return f.filter(f.x == -f.y).df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) + CAST(0.5 AS DOUBLE) AS cx FROM nation")
def from_local(spark, d):
    from tesselon.kernels import geometry as G

    rows = [{"n_nationkey": r[0], "geometry": G.box(r[0], 0, r[0] + 1, 1)} for r in table(spark, d, "nation").select("n_nationkey").collect()]
    c = GeoFrame.from_local(spark, rows, npartitions=3).centroid
    return c.df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), c.x.alias("cx"))


# Relations with a constant, and what else frames offer

@query(f"SELECT c_custkey FROM ({POINTS}) WHERE NOT (x BETWEEN -100 AND 100 AND y BETWEEN -50 AND 50)")
def disjoint_points(spark, d):
    p = points(spark, d)
    return p.filter(p.disjoint("POLYGON ((-100 -50, 100 -50, 100 50, -100 50, -100 -50))")).df.select("c_custkey")


@query(f"SELECT s_suppkey FROM ({GRID_A}) WHERE NOT (x0 <= 12 AND x1 >= 4 AND y0 <= 12 AND y1 >= 4)")
def disjoint_polygons(spark, d):
    g = polygons(grid_a(spark, d))
    return g.filter(g.disjoint("POLYGON ((4 4, 12 4, 12 12, 4 12, 4 4))")).df.select("s_suppkey")


@query(f"SELECT s_suppkey FROM ({GRID_A}) WHERE x0 >= 4 AND x1 <= 16 AND y0 >= 4 AND x1 + y1 <= 20")
def within_triangle(spark, d):
    """A constant that is no box: the box test goes to the scan, the kernel decides the rest."""
    g = grid_a(spark, d)
    return g.filter(g.within("POLYGON ((4 4, 16 4, 4 16, 4 4))")).df.select("s_suppkey")


@query("SELECT c_custkey, c_acctbal AS z, true AS has_z FROM customer")
def point_z(spark, d):
    p = points_from_xy(table(spark, d, "customer").selectExpr("c_custkey", "CAST(c_custkey AS DOUBLE) AS x", "0D AS y", "c_acctbal AS h"), "x", "y", "h")
    return p.df.select("c_custkey", p.z.alias("z"), p.has_z.alias("has_z"))


@query(f"SELECT count(*) AS n, min(x) AS west FROM ({POINTS})")
def set_index(spark, d):
    s = points(spark, d).set_index("c_custkey", npartitions=4)
    return s.df.agg(F.count("*").alias("n"), F.min("geometry__bbox.xmin").alias("west"))


@query("SELECT CAST(count(*) AS DOUBLE) AS area FROM customer WHERE c_nationkey < 5")
def unary_union_area(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return tiles(spark, d).filter("c_nationkey < 5").unary_union().select(F.round(st.area("geometry"), 6).alias("area"))


@query(f"SELECT p_partkey, round(w * h / 2, 6) AS area, 'Polygon' AS kind, true AS inside FROM ({TRIANGLES})")
def sql_functions(spark, d):
    st.register(spark)
    return spark.sql(
        "SELECT p_partkey, round(st_area(g), 6) AS area, st_geometrytype(g) AS kind, st_within(st_pointonsurface(g), g) AS inside "
        "FROM (SELECT p_partkey, st_geomfromwkt(t) AS g FROM {t})",
        t=_triangle_text(spark, d),
    )


def _triangle_text(spark, d) -> DataFrame:
    df = _sql(spark, d, TRIANGLES, "part").withColumns({"x2": F.expr("x + w"), "y2": F.expr("y + h")})
    return df.select("p_partkey", _wkt("POLYGON (({x} {y}, {x2} {y}, {x} {y2}, {x} {y}))").alias("t"))


@query(f"SELECT x, y FROM ({POINTS}) WHERE c_nationkey < 15 INTERSECT SELECT x, y FROM ({POINTS}) WHERE c_nationkey >= 10 EXCEPT SELECT x, y FROM ({POINTS}) WHERE c_nationkey = 12")
def set_operations(spark, d):
    """Points are equal as values, so sets of them are Spark's own."""
    p = points(spark, d)
    some = lambda c: from_wkb(p.df.filter(c).select("geometry"), "geometry").df.select("geometry", "geometry__bbox")
    got = GeoFrame(some("c_nationkey < 15").intersect(some("c_nationkey >= 10")).subtract(some("c_nationkey = 12")))
    return got.df.select(got.x.alias("x"), got.y.alias("y"))


@query(f"SELECT c_mktsegment, count(*) AS n FROM ({POINTS}) GROUP BY c_mktsegment")
def map_partitions_counts(spark, d):
    """A function over batches of pandas frames, then a sum of its partial counts."""

    def count(batches):
        for pdf in batches:
            yield pdf.groupby("c_mktsegment").size().rename("n").reset_index()

    return points(spark, d).map_partitions(count, "c_mktsegment string, n long").groupBy("c_mktsegment").agg(F.sum("n").alias("n"))


@query("SELECT count(*) AS n, count(*) AS length, 4 AS parts, 3 AS head FROM customer")
def partitions_add_up(spark, d):
    p = points(spark, d).repartition(4)
    each = [p.partition(i).df.agg(F.count("*").alias("n")) for i in range(p.npartitions)]
    n = concat_counts(each)
    return n.select("n", F.lit(len(p)).cast("long").alias("length"), F.lit(len(each)).alias("parts"), F.lit(len(p.head(3))).alias("head"))


def concat_counts(frames: list[DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionAll, frames).agg(F.sum("n").alias("n"))


@query("SELECT n_nationkey, n_nationkey * 2.0::DOUBLE AS px FROM nation")
def plain_and_local_frames(spark, d):
    """To a plain frame and back, and to a local frame and back: the 25 rows of ``nation``."""
    p = points_from_xy(table(spark, d, "nation").selectExpr("n_nationkey", "n_nationkey * 2D AS x", "0D AS y"), crs="EPSG:4326")
    local = GeoFrame.from_df(p.to_df(), crs="EPSG:4326").copy().compute()
    g = GeoFrame.from_local(spark, local[["n_nationkey", "geometry"]], crs="EPSG:4326", chunksize=10)
    return g.df.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), g.x.alias("px"))


@query("SELECT user_id % 16 AS cell, count(*) AS n FROM events GROUP BY ALL")
def stream_counts_by_column(spark, d):
    """The events as a stream of points in four columns and rows, counted by cell into the shared folder."""
    from tesselon.streaming.stateless import stream_points

    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    p = stream_points(rows.selectExpr("CAST(user_id % 4 AS DOUBLE) AS x", "CAST(user_id % 16 DIV 4 AS DOUBLE) AS y"), "x", "y")
    cells = p.df.selectExpr("CAST(geometry__bbox.xmin + 4 * geometry__bbox.ymin AS BIGINT) AS cell")
    path = _shared(spark)
    q = cells.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("cell bigint").parquet(f"{path}/out").groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS area FROM customer GROUP BY c_nationkey")
def union_aggregate(spark, d):
    t = tiles(spark, d)
    return t.df.groupBy("c_nationkey").agg(st.union_agg("geometry").alias("g")).select("c_nationkey", F.round(st.area("g"), 6).alias("area"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
