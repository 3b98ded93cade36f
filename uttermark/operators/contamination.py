"""How much of one corpus is found in another: exact copies, shared n-grams, best match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.text import normalize
from uttermark.functions.util import ratio
from uttermark.operators import grams
from uttermark.operators.best_match import Bleu4, RougeL, best_match


def exact_match_rate(cands: DataFrame, originals: DataFrame, text: str) -> DataFrame:
    """One row: candidates, those whose normal form is an original's, and the percentage.

    Copies among the candidates are counted before the join, so a text that makes up a
    third of the corpus is one row there.  A normal form is shuffled as its digest of 128 bits.
    """
    norm = F.unhex(F.md5(normalize(F.col(text)))).alias("norm")
    norms = cands.select(norm).groupBy("norm").agg(F.count(F.lit(1)).alias("n"))
    have = originals.select(norm).distinct()
    have = have.withColumn("_in", F.lit(True))
    out = norms.join(have, "norm", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_candidates"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("n"))), F.lit(0)).alias("n_matches"),
    )
    return out.withColumn("match_pct", ratio(F.col("n_matches"), F.col("n_candidates"), 100.0))


def ngram_jaccard(cands: DataFrame, originals: DataFrame, text: str, max_n: int = 5) -> DataFrame:
    """Per n: distinct n-grams of either side, shared ones and their Jaccard index.

    One shuffle of packed digests (see ``grams``): 24 bytes a place of a text for the orders 3 to 5.
    """
    out = grams.counted(cands, originals, text, max_n).select(
        "n", F.col("a").alias("cand_unique"), F.col("b").alias("orig_unique"),
        F.col("both").alias("shared"), F.col("either").alias("_union"),
    )
    orders = cands.sparkSession.range(1, max_n + 1).select(F.col("id").cast("int").alias("n"))
    out = orders.join(out, "n", "left").na.fill(0)
    return out.select(
        "n", "cand_unique", "orig_unique", "shared",
        ratio(F.col("shared"), F.col("_union")).alias("jaccard"),
    )


def ngram_sets(a: DataFrame, b: DataFrame, text: str, n: int) -> DataFrame:
    """The digest of every n-gram of either corpus with the sides it is found on."""
    return grams.sets(a, b, text, n)


def max_rouge_l(cands: DataFrame, originals: DataFrame, text: str, key: str) -> DataFrame:
    """Best ROUGE-L F1 of each candidate over all originals."""
    return best_match(cands, originals, key, text, {"best": RougeL})


def max_bleu4(cands: DataFrame, originals: DataFrame, text: str, key: str) -> DataFrame:
    """Best sentence BLEU-4 of each candidate against any single original."""
    return best_match(cands, originals, key, text, {"best": Bleu4})


def max_scores(cands: DataFrame, originals: DataFrame, text: str, key: str) -> DataFrame:
    """``key, rouge_l, bleu4``: both best scores of each candidate, in one pass over the texts."""
    return best_match(cands, originals, key, text, {"rouge_l": RougeL, "bleu4": Bleu4})
