"""From raw documents to an encoded training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept, and its
result is written as Parquet and read again.  All but the last return the columns of ``documents``.

In every stage an empty table gives an empty one, texts are read whole however long, and columns
beside the ones a stage reads, whatever their names, pass through (the last one drops them).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from uttermark.llm import bpe, mcd, minhash, mixing, pii
from uttermark.llm.common import documents, stored
from uttermark.llm.queries import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier rule reject go.

    Null and empty texts have fewer than 50 words, so they go; repeated rows are judged alike.
    """
    return mcd.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows without an id or a text are in no group and stay; of rows that repeat id and text one stays.
    """
    return minhash.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind in brackets; null texts stay null."""
    found = pii.find(docs, pii.fit(docs), out="pii_spans")
    return pii.redact(found, spans="pii_spans")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: rows taken twice stand twice.

    Rows without a source are a source of their own; texts without words are never taken.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the fingerprint of what they decode to; null texts have none."""
    d = bpe.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path(WORD_BPE))
    return d.select("doc_id", "source", "ids", *bpe.digests(d))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("redact", redact),
    ("mix", mix),
    ("encode", encode),
]

#: No SQL can express the fitted stages; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
