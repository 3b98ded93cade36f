"""The training-data operators as named queries over whole tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.llm import bpe, chaining, hnsw, interactions, mcd, mil, minhash, mixing, piece_counts, pii, secret_scan, substrings, vector_codes
from uttermark.llm.common import documents, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


@query("op1_bpe")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).select("doc_id", "text")
    d = bpe.encode_decode(d, public_tokenizers.path(WORD_BPE))
    return d.select("doc_id", *bpe.digests(d))


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return mcd.judge(documents(spark, folder))


@query("op3_nearest")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings"))


@query("op4_passages")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return chaining.repeated_passages(documents(spark, folder))


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    return mil.score(d, mil.fit(d, table(spark, folder, "labels")))


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).select("doc_id", "text")
    d = piece_counts.count_tokens(d, public_tokenizers.path(PIECES))
    return d.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


@query("op7_repeated_bytes")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    d = substrings.removed(documents(spark, folder))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(documents(spark, folder))


@query("op9_mix", mixing.MIX_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(documents(spark, folder)).drop("source", "copies")


@query("op10_near_duplicates", minhash.NEAR_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.groups(documents(spark, folder))


@query("op11_vector_codes", vector_codes.CODES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.report(table(spark, folder, "embeddings"))


@query("op12_filter_interactions", interactions.AUDIT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(documents(spark, folder), table(spark, folder, "labels"))


@query("op13_secret_scan")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(documents(spark, folder))
