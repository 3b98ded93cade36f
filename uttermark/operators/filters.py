"""Row filters and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.tags import bio_error


def keep(df: DataFrame, split=None, lang=None, non_empty: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one split and language whose named texts are not blank.

    Plain column predicates, so they reach the scan (or prune partitions).
    """
    if split is not None:
        df = df.where(F.col("split") == split)
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    for c in non_empty:
        df = df.where(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return df


def check_bio(df: DataFrame, tokens: str, tags: str) -> DataFrame:
    """Add ``bio_ok`` and ``bio_reason`` ('' when valid)."""
    out = df.withColumn("bio_reason", bio_error(F.col(tokens), F.col(tags)))
    return out.withColumn("bio_ok", F.col("bio_reason") == "")


def in_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Rows with ``lo <= col <= hi``."""
    return df.where(F.col(col).between(lo, hi))


def drop_label(df: DataFrame, config: DataFrame, lang: str = "lang", label: str = "intent"):
    """Drop the label each language excludes; ``config(lang, excluded)``."""
    c = config.select(F.col("lang").alias(lang), F.lower("excluded").alias("_excluded"))
    # A language may exclude several labels; its row is then one with all of them.
    c = c.groupBy(lang).agg(F.collect_set("_excluded").alias("_excluded"))
    out = df.join(c, lang, "left")
    same = F.array_contains("_excluded", F.lower(F.col(label)))
    return out.where(~F.coalesce(same, F.lit(False))).drop("_excluded")


def assert_complete(df: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``df`` there are and how many have no listing entry.

    Counts every row, where a spot check would look at a few.
    """
    have = listing.select(key).distinct().withColumn("_have", F.lit(1))
    return df.join(have, key, "left").agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count_if(F.col("_have").isNull()).alias("n_missing"),
    )
