"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing to target weights, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  All but the
last return the columns of ``documents``; the last returns each kept text's token count and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm.bpe import roundtrip_digests
from tesselon.llm.common import Scratch
from tesselon.llm.mixing import mixed_documents
from tesselon.llm.neardup import one_of_each_group
from tesselon.llm.pii import redact
from tesselon.llm.quality import quality_filter
from tesselon.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go.

    Null and empty texts go; very long ones are judged whole; repeated rows are judged alike.  Further columns stay
    as they are, whatever they are called.  An empty table stays empty.
    """
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, at a similarity of 0.8 or more, stays: the one with the smallest id.

    Documents without words or without an id stay; of rows that share an id that stays one does.  Ties cannot occur
    between ids.  Very long texts are compared whole.  Further columns stay; an empty table stays empty.
    """
    return one_of_each_group(docs, 80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind; ``n_chars`` is counted anew.

    A null text stays null, an empty one empty; very long texts are searched whole.  Of overlapping spans the one that
    starts first is replaced and what the others hold beyond it goes with it.  Rows, repeated ones too, and further
    columns stay; an empty table stays empty.
    """
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix of sources takes it, up to three times.

    A null source is a source of its own.  Documents without words are taken no time.  Repeated rows are separate
    documents; between documents of one source and size the hash of all columns decides.  Further columns stay;
    an empty table stays empty.
    """
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoded text, a row a document.

    A null or empty text has no ids; very long texts are encoded whole, in constant memory.  Repeated rows each get a
    row.  Only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
    """
    return roundtrip_digests(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Near duplicates, mixing and encoding have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
