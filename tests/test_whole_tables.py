"""Queries take whole tables: ids far beyond those of the small driver tables."""

import duckdb

from tesselon.plans.queries import oracle_sql, queries


def test_aligned_intersects_takes_ids_of_any_size(spark, tmp_path):
    spark.range(1, 501).selectExpr("id AS c_custkey", "0 AS c_nationkey", "'A' AS c_mktsegment", "0D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(250, 701).selectExpr("id AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(oracle_sql()["aligned_intersects"]).fetchall()
    got = [(r["id"], r["hit"]) for r in queries()["aligned_intersects"](spark, str(tmp_path)).collect()]
    assert len(got) == 700 and sorted(got) == sorted(want)
