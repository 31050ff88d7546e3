import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators work with."""

    def make(texts, sources=None, ids=None, partitions=2):
        ids = ids if ids is not None else range(len(texts))
        rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), "x", 7) for k, (i, t) in enumerate(zip(ids, texts))]
        return spark.createDataFrame(rows, SCHEMA).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


ODD = [None, "", " ", "\n\n", "a", "one two three four", "one two three four", "é ß x", "\x1c a \x85 b", "🙂🙃 'll 's", "<|endoftext|> x<|endoftext|>"]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD)
