import public_tokenizers
import pytest

from tesselon.llm.token_counts import token_counts, tokenizer_version


def test_counts_and_cache(make_docs, odd_texts, spark, vocab, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab)
    texts = odd_texts + ["hello world " * 600]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        rows = token_counts(make_docs(texts), vocab, cache).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        for r in rows:
            t = texts[r.doc_id] or ""
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    stored = spark.read.parquet(f"{cache}/{tokenizer_version(vocab)}")
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in texts})


def test_only_misses_are_encoded(make_docs, spark, vocab, tmp_path):
    cache = f"file://{tmp_path}/cache"
    token_counts(make_docs(["a b", "c"]), vocab, cache).collect()
    # A stored count wins over encoding: change it and see it come back.
    path = f"{cache}/{tokenizer_version(vocab)}"
    rows = spark.read.parquet(path).collect()
    spark.createDataFrame([(r.digest, 99) for r in rows], "digest binary, n_tokens long").write.mode("overwrite").parquet(path + "x")
    spark.read.parquet(path + "x").write.mode("overwrite").parquet(path)
    got = {r.doc_id: r.n_tokens for r in token_counts(make_docs(["a b", "new text"]), vocab, cache).collect()}
    assert got[0] == 99 and got[1] == 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(make_docs, name):
    rows = token_counts(make_docs(["Hello world", None]), public_tokenizers.path(name)).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in rows} == {0: True, 1: False}


def test_very_long_texts_are_streamed(make_docs, vocab):
    from tokenizers import Tokenizer

    from tesselon.llm import token_counts as C

    text = "word and 'll 🙂 " * 80_000
    assert len(text) >= C.BATCH_CHARS
    rows = {r.doc_id: r.n_tokens for r in token_counts(make_docs([text, "a b"]), vocab).collect()}
    assert rows == {0: len(Tokenizer.from_file(vocab).encode(text, add_special_tokens=False).ids), 1: 2}


def test_empty_table(make_docs, vocab):
    assert token_counts(make_docs(["x"]).filter("doc_id < 0"), vocab).count() == 0
