"""The registered queries that have SQL, against it on the smallest driver tables; the others for their columns."""

import os

import duckdb
import pytest

from tesselon.llm.queries import oracle_sql, queries

DATA = os.environ.get("TESSELON_TEST_DATA", "/root/testdata/sf0.001")

COLUMNS = {
    "op1_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op2_nearest_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_license_scan": ["doc_id", "n_matches", "licenses"],
    "op10_language_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    rel = db.sql(oracle_sql()[name])
    assert got == sorted((tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns_and_rows(spark, db, name):
    df = queries()[name](spark, DATA)
    assert set(COLUMNS[name]) <= set(df.columns)
    n = df.count()
    assert n == (spark.read.parquet(f"{DATA}/documents.parquet").count() if name[2] != "2" else n) and n > 0


def test_token_counts_join_a_lasting_cache(spark, db, tmp_path):
    """Where a cache is named, a second run of the query joins all its counts and encodes nothing."""
    from tesselon.llm import queries as Q
    from tesselon.llm.token_counts import tokenizer_version

    spark.conf.set("spark.tesselon.tokenCache", f"file://{tmp_path}/cache")
    try:
        runs = []
        for _ in range(2):
            rows = sorted(tuple(r) for r in Q.op1_token_counts(spark, DATA).collect())
            stored = spark.read.parquet(f"file://{tmp_path}/cache/{tokenizer_version(Q.vocabulary_path())}")
            runs.append((rows, stored.count(), stored.select("digest").distinct().count()))
        assert runs[0] == runs[1] and runs[0][1] == runs[0][2] > 0
    finally:
        spark.conf.unset("spark.tesselon.tokenCache")
