"""Choosing reference clips per speaker."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pick_closest(
    df: DataFrame, group: str, x: str, order: list[str], target=6.0, hi=12.0
) -> DataFrame:
    """Of all rows of a group with ``x <= hi`` the one closest to the target, the earliest on
    ties: one aggregate that merges on the map side."""
    rows = df.where(F.col(x) <= hi)
    key = F.struct(F.abs(F.col(x) - target), *order)
    best = rows.groupBy(group).agg(F.min_by(F.struct(*df.columns), key).alias("_b"))
    return best.select("_b.*")


def pick_diverse(
    df: DataFrame, group: str, cls: str, x: str, order: list[str], k=8, lo=5.0, hi=12.0
) -> DataFrame:
    """Up to k rows per group: the longest of each class in class order, then the longest
    of the rest.  ``ref_idx`` numbers the choice by class.

    All rows are looked at.  No class can give more than k, and Spark applies that limit
    before the shuffle, so a large group sends only k rows per class and task.
    """
    rows = df.where(F.col(x).between(lo, hi))
    in_class = W.partitionBy(group, cls).orderBy(F.desc(x), *order)
    rows = rows.withColumn("_rc", F.row_number().over(in_class)).where(F.col("_rc") <= k)
    first = F.col("_rc") == 1
    pick = W.partitionBy(group).orderBy(
        F.when(first, 0).otherwise(1),
        F.when(first, F.col(cls)),
        F.when(~first, -F.col(x)),
        cls,
        *order,
    )
    rows = rows.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= k)
    idx = W.partitionBy(group).orderBy(cls, "_r")
    return rows.withColumn("ref_idx", F.row_number().over(idx) - 1).drop("_rc", "_r")


def pick_until(
    df: DataFrame,
    group: str,
    x: str,
    order: list[Column],
    target=6.0,
    lo=5.0,
    hi=9.0,
    gap=0.15,
) -> DataFrame:
    """Rows of each group in order until their lengths (plus a gap each) reach the target.

    A row that would pass ``hi`` ends the choice once ``lo`` is held; groups that stay
    below ``lo`` are dropped.  Lengths only grow, so running sums decide it.  Sums are
    decimal, so they do not depend on how the rows are split.  Rows without a length or
    with a negative one are left out.

    Every row adds at least the gap, so no more than ``target / gap`` rows can matter.  Spark
    applies that limit before the shuffle: a large group sends so many rows a task.
    """
    d = F.col(x).cast("decimal(18,6)")
    step = d + F.lit(gap).cast("decimal(18,6)")
    first = W.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_d", d).where("_d >= 0").withColumn("_r", F.row_number().over(first))
    rows = rows.where(F.col("_r") <= math.ceil(target / gap)).withColumn("_step", step)
    upto = first.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("_step").over(upto))
    held = F.col("_cum") - F.col("_step")
    rows = rows.where(held < target)
    ends = (held + F.col("_d") > hi) & (held >= lo)
    whole = W.partitionBy(group)
    rows = rows.withColumn("_stop", F.min(F.when(ends, F.col("_cum"))).over(whole))
    rows = rows.where(F.col("_stop").isNull() | (F.col("_cum") < F.col("_stop")))
    rows = rows.withColumn("total_s", F.max("_cum").over(whole))
    return rows.where(F.col("total_s") >= lo).drop("_d", "_r", "_step", "_cum", "_stop")


def round_robin(df: DataFrame, idx: str, n: int, k: int | None = None) -> DataFrame:
    """Speaker ``idx mod n``; with k references each, reference ``(idx div n) mod k``."""
    out = df.withColumn("speaker", F.pmod(F.col(idx), F.lit(n)))
    if k:
        out = out.withColumn("ref_idx", F.pmod(F.expr(f"{idx} div {n}"), F.lit(k)))
    return out
