"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) is the data, ``BENCH_CPUS`` (default 8) the threads.
``point_in_box_10m`` takes 10,000,000 normally distributed points in 16 partitions and counts those
within the unit box, by arithmetic on the companion and, as ``..._kernel``, by the vectorised kernel.
``threads`` has the seconds of the same two on one and on four threads and how many times faster four
are; the kernel there takes 2,000,000 points.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def point_in_box(spark, n: int, generic: bool):
    from pyspark.sql import functions as F

    from tesselon.functions import st
    from tesselon.operators.frame import points_from_xy

    df = spark.range(0, n, 1, 16).select(F.randn(1).alias("x"), F.randn(2).alias("y"))
    p = points_from_xy(df)
    unit = "POLYGON ((1 0, 1 1, 0 1, 0 0, 1 0))"
    return p.df.filter(st.predicates["within"](p.geometry, st.literal(unit)) if generic else p.within(unit)).agg(F.count("*").alias("n"))


HEADLINE = (
    "points_within_box", "cx_slice", "clip_box", "sjoin_points_within_boxes", "sjoin_boxes_cover_points", "sjoin_intersects", "hilbert_distance",
    "geohash_string", "spatial_shuffle_hilbert", "area_and_length", "centroid", "to_crs_mercator", "buffer_points", "overlays", "dissolve_sum", "union_all_area",
)


def session(cpus: int):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from tesselon.plans.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(cpus)
    found, q = {}, queries()
    q["points_within_box"](spark, sf_dir).collect()
    for n in HEADLINE:
        found[n] = seconds(q[n](spark, sf_dir))
    found["point_in_box_10m"] = seconds(point_in_box(spark, 10_000_000, False))
    found["point_in_box_10m_kernel"] = seconds(point_in_box(spark, 10_000_000, True))
    spark.stop()
    threads = {}
    for k in (1, 4):
        spark = session(k)
        seconds(point_in_box(spark, 100_000, True))
        threads[f"box_{k}"] = seconds(point_in_box(spark, 10_000_000, False))
        threads[f"kernel_{k}"] = seconds(point_in_box(spark, 2_000_000, True))
        spark.stop()
    for n in ("box", "kernel"):
        threads[f"{n}_ratio"] = round(threads[f"{n}_1"] / threads[f"{n}_4"], 2)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    sf = float(sf) if sf.replace(".", "").isdigit() else sf
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "threads": threads, "sf": sf}))


if __name__ == "__main__":
    main()
