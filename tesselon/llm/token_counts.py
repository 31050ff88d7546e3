"""Token counts through a digest cache.

Each text's normalised content (null reads as empty; then the tokenizer's own normaliser, none for
byte-level vocabularies, which therefore digest the plain UTF-8 bytes) gets a SHA-256.  Counts are
stored per (tokenizer-version digest, content digest).  A run joins documents to the stored counts,
encodes only the distinct texts that are missing and appends them.

Defined results.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows each get a row, rows
with a null ``doc_id`` too.  Very long texts are counted whole, in constant memory where the vocabulary
is byte-level.  An empty table gives an empty result.  Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch, bounded_batches

#: Characters of text given to the library at once; bounds what one call holds.
BATCH_CHARS = 1 << 20
STORED = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file with the name and version of the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = sentencepiece if path.endswith(".model") else tokenizers
    h = hashlib.sha256(f"{lib.__name__} {lib.__version__}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from a list of texts to their token counts, no begin, end or added special tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    whole = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def count(texts):
        if max(map(len, texts), default=0) < BATCH_CHARS:
            return whole(texts)
        # A very long text is streamed, which gives the same ids from bounded memory; the transducer is built for the first one.
        stream = _stream(path)
        if stream is None:
            return whole(texts)
        return [stream(t) if len(t) >= BATCH_CHARS else whole([t])[0] for t in texts]

    return count


@lru_cache(maxsize=4)
def _stream(path: str):
    from tesselon.llm.bpe import BLOCK, transducer

    try:
        tr = transducer(path)
    except ValueError:  # not a byte-level vocabulary: no streaming form
        return None
    return lambda t: sum(map(len, tr.stream(t[i : i + BLOCK] for i in range(0, len(t), BLOCK))))


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        count = counter(path)
        seen: set[bytes] = set()
        for b in batches:
            # Rows that repeat with their id meet in one task; their text is encoded once there.
            keys = [x.as_py() for x in b.column("digest")]
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            n, part, held = [], [], 0
            for i in new:
                s = b.column("text")[i].as_py()
                part.append(s)
                held += len(s)
                if held >= BATCH_CHARS:
                    n += count(part)
                    part, held = [], 0
            if part:
                n += count(part)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``cache_path`` is a folder in a store all executors share; it is made when absent and outlives the
    run.  Without one the cache lives in the run's scratch folder, so every distinct text is a miss.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "token-cache")
    cache = f"{cache_path or scratch.path}/{tokenizer_version(tokenizer_path)}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    # Digests and sizes once for all later steps; ``part`` tells copies with different ids apart.
    keyed = scratch.write(docs.select("doc_id", digest.alias("digest"), F.xxhash64("doc_id").alias("part"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    spark.createDataFrame([], STORED).write.mode("append").parquet(cache)
    stored = spark.read.schema(STORED).parquet(cache).select("digest")
    missing = keyed.groupBy("digest").agg(F.min("part").alias("part")).join(stored, "digest", "left_anti")
    # The chosen row's text meets its digest in a hash join that streams the texts: none is sorted, and copies of one text are spread.
    texts = docs.select(digest.alias("digest"), F.xxhash64("doc_id").alias("part"), text.alias("text"))
    texts = texts.join(missing.hint("shuffle_hash"), ["digest", "part"], "left_semi").select("digest", "text")
    texts.mapInArrow(_encode(tokenizer_path), STORED).write.mode("append").parquet(cache)
    # Another run may have appended the same digest meanwhile.
    counts = spark.read.schema(STORED).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
