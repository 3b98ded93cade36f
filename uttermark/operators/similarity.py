"""Vectors: group centroids and cosine similarities, worked out inside the row."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9  # added to each norm, as a fixed value


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column, eps: float = EPS) -> Column:
    return F.sqrt(dot(a, a)) + eps


def cosine(a: Column, b: Column, eps: float = EPS) -> Column:
    """Cosine of two arrays; null where one is null."""
    return dot(a, b) / norm(a, eps) / norm(b, eps)


def sums(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """``total`` (element-wise sum) and ``n`` per group; partial sums merge on the map side."""
    stats = Summarizer.metrics("sum", "count").summary(array_to_vector(F.col(vec).cast("array<double>")))
    s = df.where(F.col(vec).isNotNull()).groupBy(*by).agg(stats.alias("_s"))
    return s.select(*by, vector_to_array("_s.sum").alias("total"), F.col("_s.count").alias("n"))


def centroids(df: DataFrame, by: list[str], vec: str) -> DataFrame:
    """``center`` (mean vector) per group."""
    return sums(df, by, vec).select(
        *by, F.transform("total", lambda x: x / F.col("n")).alias("center")
    )


def pairwise_centroid_cosine(cents: DataFrame, label: str) -> DataFrame:
    """Cosine of every pair of group centroids, ``label_a < label_b``: one row per pair of
    groups is what this operator returns.  ``mean_centroid_cosine`` grows with the groups only."""
    a = cents.select(F.col(label).alias("label_a"), F.col("center").alias("a"))
    b = cents.select(F.col(label).alias("label_b"), F.col("center").alias("b"))
    both = a.join(b, F.col("label_a") < F.col("label_b"))
    return both.select("label_a", "label_b", cosine(F.col("a"), F.col("b")).alias("cosine"))


def unit_sum(cents: DataFrame) -> DataFrame:
    """One row: the sum of the centroids' unit vectors and the number of centroids."""
    unit = F.transform("center", lambda x: x / F.col("_norm"))
    units = cents.withColumn("_norm", norm(F.col("center"))).select(unit.alias("_unit"))
    return sums(units, [], "_unit").select(F.col("total").alias("_all"), F.col("n").alias("_k"))


def mean_centroid_cosine(cents: DataFrame, label: str) -> DataFrame:
    """Per group the mean cosine of its centroid to all others: the dot product with the sum
    of the others' unit vectors, so no pair is made.  Null for a single group."""
    d = cents.crossJoin(unit_sum(cents))  # one row
    c = F.col("center")
    # Its own unit vector is in the sum; the rest is what the others add.
    rest = dot(c, F.col("_all")) / norm(c) - dot(c, c) / norm(c) / norm(c)
    return d.select(label, F.when(F.col("_k") > 1, rest / (F.col("_k") - 1)).alias("mean_cosine"))


def centroid_similarity(df: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    """Per row: cosine to the centroid of its own group without the row itself
    (``self_cos``), to the whole own centroid (``own_cos``), and the mean cosine to the
    other groups' centroids (``cross_cos``).  Groups of one row have a null self_cos.

    The mean cosine to many centroids is the dot product with the sum of their unit
    vectors, so no row meets another group and the work does not grow with the groups.
    One scan makes the sums, one the scores.
    """
    groups = sums(df, [label], vec)
    n = F.col("n")
    groups = groups.withColumn("center", F.transform("total", lambda x: x / n))
    groups = groups.crossJoin(unit_sum(groups.select("center")))  # one row
    x = F.col("_x")
    rows = df.select(key, label, F.col(vec).cast("array<double>").alias("_x")).join(groups, label)
    rest = F.zip_with("total", x, lambda s, v: (s - v) / F.greatest(n - 1, F.lit(1)))
    c = F.col("center")
    crossed = dot(x, F.col("_all")) / norm(x) - dot(x, c) / norm(c) / norm(x)
    out = rows.select(
        key,
        label,
        F.when(n > 1, cosine(x, rest)).alias("self_cos"),
        cosine(x, c).alias("own_cos"),
        F.when(F.col("_k") > 1, crossed / F.when(F.col("_k") > 1, F.col("_k") - 1)).alias("cross_cos"),
    )
    return out.withColumn("delta", F.col("own_cos") - F.col("cross_cos"))
