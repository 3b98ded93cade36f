"""Joins: presence, inventories, lookups, slot matching, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.functions.text import canonicalize
from uttermark.functions.util import ratio, unnest
from uttermark.operators.order import first_seen


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the finished output yet (resume)."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys of ``expected`` that ``actual`` lacks."""
    return expected.join(actual.select(key).distinct(), key, "left_anti")


def diff_inventory(expected: DataFrame, actual: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Both differences of two key sets: ``side, n_keys, examples`` (the first n keys).

    Only the examples are collected; the rank limit is applied before the shuffle.
    """
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    diff = e.join(a, key, "full_outer").select(
        key,
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").alias("side"),
    )
    diff = diff.where(F.col("side").isNotNull())
    counts = diff.groupBy("side").agg(F.count(F.lit(1)).alias("n_keys"))
    top = diff.withColumn("_r", F.row_number().over(W.partitionBy("side").orderBy(key)))
    first = (
        top.where(F.col("_r") <= n)
        .groupBy("side")
        .agg(F.array_sort(F.collect_list(key)).alias("examples"))
    )
    return counts.join(first, "side")


def overlap_partition(test: DataFrame, train: DataFrame, text: str) -> DataFrame:
    """Add ``part``: 'overlap' when the text (trimmed, lower case) is in train, else 'novel'."""
    key = F.lower(F.trim(F.col(text)))
    seen = train.select(F.md5(key).alias("_t")).distinct().withColumn("_seen", F.lit(True))
    out = test.withColumn("_t", F.md5(key)).join(seen, "_t", "left")
    return out.withColumn("part", F.when(F.col("_seen"), "overlap").otherwise("novel")).drop(
        "_t", "_seen"
    )


def attach_by_text(
    df: DataFrame, files: DataFrame, text: str, file: str, order: list[str]
) -> DataFrame:
    """Left join of a file by canonical text; of several files the first in ``order``."""
    right = files.select(F.md5(canonicalize(F.col(text))).alias("_t"), file, *order)
    right = first_seen(right.select("_t", file, *order), ["_t"], order).select("_t", file)
    return df.withColumn("_t", F.md5(canonicalize(F.col(text)))).join(right, "_t", "left").drop("_t")


def attach_by_position(df: DataFrame, files: DataFrame, position: str, pattern: str) -> DataFrame:
    """Left join of ``files(file)`` by the name built from the row's position."""
    named = df.withColumn("file", F.format_string(pattern, F.col(position)))
    have = files.select("file").distinct().withColumn("found", F.lit(True))
    return named.join(have, "file", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def bag_match(
    df: DataFrame, key: list[str], gold: str, pred: str, require_intent: bool = False
) -> DataFrame:
    """tp / fp / fn per row key and slot name; each gold value can be used once.

    ``gold`` and ``pred`` are ``array<struct<slot_name, raw_value>>``; values compare in
    lower case.  Matching a bag against a bag is the smaller of the two counts, so no
    pairing is needed.  With ``require_intent`` the predictions of rows whose
    ``pred_intent`` is not ``gold_intent`` are ignored.
    """
    if require_intent:
        same = F.col("pred_intent").eqNullSafe(F.col("gold_intent"))
        df = df.withColumn(pred, F.when(same, F.col(pred)))

    def side(col: str, g: int, p: int) -> DataFrame:
        s = unnest(df, key, F.col(col), "_s")
        return s.select(
            *key,
            F.col("_s.slot_name").alias("slot_name"),
            F.lower("_s.raw_value").alias("_v"),
            F.lit(g).alias("_g"),
            F.lit(p).alias("_p"),
        )

    both = side(gold, 1, 0).unionByName(side(pred, 0, 1))
    bags = both.groupBy(*key, "slot_name", "_v").agg(
        F.sum("_g").alias("_g"), F.sum("_p").alias("_p")
    )
    return bags.groupBy(*key, "slot_name").agg(
        F.sum(F.least("_g", "_p")).alias("tp"),
        F.sum(F.greatest(F.col("_p") - F.col("_g"), F.lit(0))).alias("fp"),
        F.sum(F.greatest(F.col("_g") - F.col("_p"), F.lit(0))).alias("fn"),
    )


def keyword_confusion(
    df: DataFrame, text: str, intent: str, rules: dict[str, list[str]]
) -> DataFrame:
    """One row per (row, other intent) one of whose patterns the lower-cased text matches.

    ``pattern`` is the first matching pattern of that intent.  The rules are
    configuration in code, so they become literals of one projection, not a join.
    """
    low = F.lower(F.col(text))

    def first_match(patterns: list[str]) -> Column:
        return F.coalesce(*[F.when(low.rlike(p), F.lit(p)) for p in patterns])

    hits = [
        F.struct(
            F.lit(other).alias("suggested"),
            F.when(F.col(intent) != other, first_match(patterns)).alias("pattern"),
        )
        for other, patterns in rules.items()
    ]
    found = F.filter(F.array(*hits), lambda h: h["pattern"].isNotNull())
    out = unnest(df, ["*"], found, "_hit")
    return out.select(*df.columns, "_hit.suggested", "_hit.pattern")


def coverage_by_group(df: DataFrame, key: str, group: str, base: str) -> DataFrame:
    """Per group other than ``base``: keys shared with it, missing from it, and extra.

    One pass: a key marks its groups by whether ``base`` is among them.  After the distinct
    step a key has one row per group.  Null keys are never shared; a null group is left out.
    """
    keys = df.where(F.col(group).isNotNull()).select(group, key).distinct()
    in_base = F.max(F.col(group) == base).over(W.partitionBy(key)) & F.col(key).isNotNull()
    per = keys.withColumn("_in", in_base).groupBy(group).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_in")).alias("n_shared"),
        F.count_if(~F.col("_in")).alias("n_extra"),
    )
    # One row per group, so one window over all of them is small.
    n_base = F.max(F.when(F.col(group) == base, F.col("n_keys"))).over(W.partitionBy())
    out = per.withColumn("_n", F.coalesce(n_base, F.lit(0))).where(F.col(group) != base)
    return out.select(
        group,
        "n_keys",
        "n_shared",
        "n_extra",
        (F.col("_n") - F.col("n_shared")).alias("n_missing"),
        ratio(F.col("n_shared"), F.col("_n"), 100.0).alias("coverage_pct"),
    )


def upsert(
    old: DataFrame, new: DataFrame, key: str, replace: list[str], keep: list[str] = ()
) -> DataFrame:
    """Full outer merge: ``replace`` columns come from ``new`` where it has them, ``keep``
    columns from ``old`` where it has them."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in (*replace, *keep)])
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in (*replace, *keep)])
    both = o.join(n, key, "full_outer")
    cols = [F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in replace]
    cols += [F.coalesce(f"_o_{c}", f"_n_{c}").alias(c) for c in keep]
    return both.select(key, *cols)


def merge_gazetteers(a: DataFrame, b: DataFrame, order: str = "pos") -> DataFrame:
    """Union of two value lists ``(entity, value, pos)``: every value of ``a``, then those
    of ``b`` whose lower-cased value is not there yet (the first of them)."""
    fresh = b.withColumn("_v", F.lower("value"))
    have = a.select("entity", F.lower("value").alias("_v")).distinct()
    fresh = fresh.join(have, ["entity", "_v"], "left_anti")
    fresh = first_seen(fresh.select("entity", "_v", "value", order), ["entity", "_v"], [order])
    return a.select("entity", "value", F.lit("a").alias("origin")).unionByName(
        fresh.select("entity", "value", F.lit("b").alias("origin"))
    )
