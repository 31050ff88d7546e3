import math
import random

from pyspark.sql import functions as F

from tesselon.streaming.stateful import path_lengths, session_counts
from tesselon.streaming.stateless import stream_points

SCHEMA = "k string, x double, y double, t timestamp"


def files(spark, path, batches):
    """A stream of one file a batch, in order of file time."""
    import os
    import time

    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, x double, y double, t string").withColumn("t", F.to_timestamp("t"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
        os.makedirs(f"{path}/in", exist_ok=True)
        part = next(f for f in os.listdir(f"{path}/b{i}") if f.startswith("part"))
        os.rename(f"{path}/b{i}/{part}", f"{path}/in/{i:02d}.parquet")
        os.utime(f"{path}/in/{i:02d}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return stream_points(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), "x", "y")


def run(df, name, spark, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_path_lengths_take_late_points_in_their_place(spark, tmp_path):
    rnd = random.Random(4)
    points = [(rnd.choice("ab"), rnd.uniform(0, 9), rnd.uniform(0, 9), m) for m in range(0, 120)]
    batches = [points[i : i + 40] for i in range(0, 120, 40)]
    # The last points of a batch and the first of the next change places: late, but within the watermark.
    batches[0][-5:], batches[1][:5] = batches[1][:5], batches[0][-5:]
    # A point that is later than the watermark allows is dropped; one far ahead lets the others out.
    batches[2].append(("a", 100.0, 100.0, 1))
    batches.append([("z", 0.0, 0.0, 600)])
    batches.append([("z", 0.0, 0.0, 601)])
    stream = files(spark, tmp_path, [[(k, x, y, at(m)) for k, x, y, m in b] for b in batches])
    got = {}
    for r in run(path_lengths(stream, "k", "t", "20 minutes"), "paths", spark):
        got.setdefault(r.key, []).append((r.time, r.x, r.y, r.length))
    for k in "ab":
        mine = [(x, y) for key, x, y, _ in points if key == k]
        total, want = 0.0, []
        for i, p in enumerate(mine):
            total += math.dist(p, mine[i - 1]) if i else 0.0
            want.append((*p, total))
        path = sorted(got[k])
        assert [r[1:3] for r in path] == [w[:2] for w in want]
        assert all(abs(r[3] - w[2]) < 1e-9 for r, w in zip(path, want))


def test_sessions_by_cell(spark, tmp_path):
    rows = [[("a", 1.0, 1.0, at(m)) for m in (0, 3, 6, 40, 42)] + [("a", 9.0, 9.0, at(4))], [("a", 1.0, 1.0, at(8))], [("z", 5.0, 5.0, at(500))], [("z", 5.0, 5.0, at(501))], [("z", 5.0, 5.0, at(502)), ("a", 1.0, 1.0, at(9))]]
    stream = files(spark, tmp_path, rows)
    got = run(session_counts(stream, "t", "60 minutes", "5 minutes", ["k"], (0, 0, 10, 10), 2), "sessions", spark)
    # The late visit at minute 8 joins the first session; the one at minute 9, after the watermark, is dropped.
    assert sorted(r.n for r in got if r.k == "a") == [1, 2, 4]
