"""Vocabularies and label indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.util import unnest
from uttermark.operators.order import numbered

# Ids 0..3 of a word vocabulary.
RESERVED = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def index_labels(df: DataFrame) -> DataFrame:
    """``(label, idx)``: distinct labels numbered from 0 in sorted order."""
    d = df.select("label").distinct()
    out = numbered(d, [], [F.col("label")])
    return out.select("label", (F.col("rn") - 1).alias("idx"))


def build_vocab(df: DataFrame, tokens: str, min_freq: int = 1) -> DataFrame:
    """``(word, idx, n)``: words by falling frequency, ties by word, after the four
    reserved entries (whose n is null).

    The order is global, over ranges of (count, word), as most words of a large corpus share
    the count 1.
    """
    words = unnest(df, [], F.col(tokens), "word").groupBy(F.lower("word").alias("word"))
    counts = words.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_freq)
    out = numbered(counts, [], [F.desc("n"), F.col("word")])
    ranked = out.select("word", (F.col("rn") + len(RESERVED) - 1).alias("idx"), "n")
    fixed = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(w) for w in RESERVED])).alias("idx", "word")
    )
    return fixed.select(
        "word", F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast("bigint").alias("n")
    ).unionByName(ranked)


def unseen_values(real: DataFrame, synth: DataFrame, value: str, noise: list[str]) -> DataFrame:
    """Values used in ``real`` but never in ``synth`` nor listed as noise, with their
    frequency in ``real``."""
    norm = F.lower(F.trim(F.col(value)))
    counts = real.groupBy(norm.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("value") != "") & ~F.col("value").isin(noise))
    return counts.join(synth.select(norm.alias("value")).distinct(), "value", "left_anti")


def vocab_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values of one side only: ``side`` is 'only_a' or 'only_b'."""
    both = a.select(F.col(col).alias("value"), F.lit(1).alias("s")).unionByName(
        b.select(F.col(col).alias("value"), F.lit(2).alias("s"))
    )
    sides = both.groupBy("value").agg(F.bit_or("s").alias("s")).where("s < 3")
    return sides.select("value", F.when(F.col("s") == 1, "only_a").otherwise("only_b").alias("side"))


def mix(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Union of two corpora with the origin of each row."""
    r = real.withColumn("origin", F.lit("real"))
    return r.unionByName(synth.withColumn("origin", F.lit("synthetic")))
