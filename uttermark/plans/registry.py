"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttermark.functions.text import word_tokens
from uttermark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The input tables of one folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def wide(self, name: str, *cols: str) -> DataFrame:
        """A table for heavy work per row: all cores take part even if it is one file."""
        return spread(getattr(self, name).select(*cols))

    # Views that several queries share; each has a SQL twin below.

    @property
    def turns(self) -> DataFrame:
        """One row per conversation turn, with tokens."""
        return self.wide("conversations", "*").select(
            F.concat_ws(":", "conv_id", "turn").alias("utt_id"),
            "conv_id",
            "turn",
            "role",
            "text",
            word_tokens(F.col("text")).alias("tokens"),
        )

    @property
    def tagged(self) -> DataFrame:
        """Turns with a gold and a predicted tag per token, made by two token rules."""
        return self.turns.select(
            "*",
            F.transform("tokens", gold_tag).alias("gold"),
            F.transform("tokens", pred_tag).alias("pred"),
        )


def _prefix(token):
    return F.when(F.length(token) % 2 == 1, "B-").otherwise("I-")


def gold_tag(token):
    n = F.length(token)
    return (
        F.when(n >= 8, F.concat(_prefix(token), F.lit("long")))
        .when(n.between(5, 6), F.concat(_prefix(token), F.lit("mid")))
        .otherwise("O")
    )


def pred_tag(token):
    n = F.length(token)
    return (
        F.when(n >= 7, F.concat(_prefix(token), F.lit("long")))
        .when(n == 5, F.concat(_prefix(token), F.lit("mid")))
        .when(n == 1, "B-one")
        .otherwise("O")
    )


SQL_WORD = r"'[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)?'"

TURNS_SQL = f"""turns AS (
  SELECT conv_id || ':' || turn AS utt_id, conv_id, turn, role, text,
         regexp_extract_all(lower(text), {SQL_WORD}) AS tokens
  FROM conversations)"""

GOLD_SQL = """CASE WHEN length(t) >= 8 THEN (CASE WHEN length(t) % 2 = 1 THEN 'B-' ELSE 'I-' END) || 'long'
  WHEN length(t) BETWEEN 5 AND 6 THEN (CASE WHEN length(t) % 2 = 1 THEN 'B-' ELSE 'I-' END) || 'mid'
  ELSE 'O' END"""
PRED_SQL = """CASE WHEN length(t) >= 7 THEN (CASE WHEN length(t) % 2 = 1 THEN 'B-' ELSE 'I-' END) || 'long'
  WHEN length(t) = 5 THEN (CASE WHEN length(t) % 2 = 1 THEN 'B-' ELSE 'I-' END) || 'mid'
  WHEN length(t) = 1 THEN 'B-one' ELSE 'O' END"""

TAGGED_SQL = f"""{TURNS_SQL}, tagged AS (
  SELECT *, list_transform(tokens, lambda t: {GOLD_SQL}) AS gold,
         list_transform(tokens, lambda t: {PRED_SQL}) AS pred
  FROM turns)"""


def spans_sql(tags: str, name: str, source: str = "tagged") -> str:
    """CTEs that turn a tag list into span rows by gaps and islands."""
    return f"""{name}_t AS (
  SELECT utt_id, unnest({tags}) AS tag, generate_subscripts({tags}, 1) - 1 AS pos FROM {source}),
{name}_y AS (
  SELECT *, CASE WHEN tag LIKE 'B-%' OR tag LIKE 'I-%' THEN substr(tag, 3) END AS ty FROM {name}_t),
{name}_f AS (
  SELECT *, CASE WHEN pos = 0 OR tag LIKE 'B-%' OR ty IS DISTINCT FROM
     lag(ty) OVER (PARTITION BY utt_id ORDER BY pos) THEN 1 ELSE 0 END AS st FROM {name}_y),
{name}_s AS (
  SELECT *, sum(st) OVER (PARTITION BY utt_id ORDER BY pos) AS sid FROM {name}_f),
{name} AS (
  SELECT utt_id, min(pos) AS s, max(pos) + 1 AS e, min(ty) AS label
  FROM {name}_s WHERE ty IS NOT NULL GROUP BY utt_id, sid)"""


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL twin if any."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
