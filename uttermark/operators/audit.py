"""Corpus audits: counts, lengths, tag quality, duplicates, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions.tags import begin_tags, spans, span_text, tag_type
from uttermark.functions.text import opener
from uttermark.functions.util import ratio, unnest
from uttermark.operators.order import exact_percentiles, numbered


def counts_and_shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per value and their share of all rows in percent."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return c.crossJoin(total).select(
        *by, "n", ratio(F.col("n"), F.col("_total"), 100.0).alias("share_pct")
    )


def language_table(df: DataFrame, splits: list[str]) -> DataFrame:
    """Per language: rows of each split, distinct intents, distinct slot types.

    ``df`` has ``lang, split, intent, tags``.  One pass: a row gives its split, its intent and
    its slot types, equal ones are counted together before the shuffle, and only then rolled
    up by language.  Null intents do not count; a null language is a group of its own.
    """

    def item(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    items = F.concat(
        F.array(item("split", F.col("split")), item("intent", F.lower("intent"))),
        F.coalesce(F.transform("tags", lambda t: item("type", tag_type(t))), F.array()),
    )
    seen = unnest(df, ["lang"], items, "_i").groupBy("lang", "_i").agg(F.count(F.lit(1)).alias("_n"))
    kind, value = F.col("_i.kind"), F.col("_i.value")

    def distinct(k: str) -> Column:
        return F.count_if((kind == k) & value.isNotNull())

    return seen.groupBy("lang").agg(
        *[
            F.sum(F.when((kind == "split") & (value == s), F.col("_n")).otherwise(0)).alias(f"n_{s}")
            for s in splits
        ],
        distinct("intent").alias("n_intents"),
        distinct("type").alias("n_slot_types"),
    )


def length_stats(df: DataFrame, by: list[str], n_tokens: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(n_tokens).alias("avg_tokens"),
        F.min(n_tokens).alias("min_tokens"),
        F.max(n_tokens).alias("max_tokens"),
        F.sum(n_tokens.cast("bigint")).alias("total_tokens"),
    )


def duplicate_texts(df: DataFrame, text: str, label: str) -> DataFrame:
    """Texts (trimmed, lower case) found more than once: copies and distinct labels.

    Grouped by (text, label) first, so copies merge before the text is shuffled.
    """
    key = F.lower(F.trim(F.col(text)))
    per = df.groupBy(F.md5(key).alias("text_md5"), F.col(label).alias("_l")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    out = per.groupBy("text_md5").agg(
        F.sum("_n").alias("n_copies"), F.count(F.lit(1)).alias("n_labels")
    )
    return out.where("n_copies > 1")


def label_vocab(df: DataFrame, intent: str, tags: str) -> DataFrame:
    """``kind, label, idx``: intents, and tags with an I- for each B- and PAD last.

    Observed labels are numbered in sorted order, the added I- tags after them.
    One pass: each B- tag also proposes its I- tag, and of equal labels the observed one counts.
    """

    def item(kind: str, label: Column, step: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), label.alias("label"), F.lit(step).alias("step"))

    begins = F.filter(F.col(tags), lambda t: t.startswith("B-"))
    items = F.concat(
        F.array(item("intent", F.col(intent), 0)),
        F.coalesce(F.transform(tags, lambda t: item("tag", t, 0)), F.array()),
        F.coalesce(
            F.transform(
                begins,
                lambda t: item("tag", F.concat(F.lit("I-"), F.substring(t, 3, 2147483647)), 1),
            ),
            F.array(),
        ),
    )
    rows = unnest(df, [], items, "_i").groupBy("_i.kind", "_i.label").agg(F.min("_i.step").alias("step"))
    rows = rows.where((F.col("kind") == "intent") | F.col("label").isNotNull())
    pad = df.sparkSession.range(1).select(
        F.lit("tag").alias("kind"), F.lit("PAD").alias("label"), F.lit(2).alias("step")
    )
    out = numbered(rows.unionByName(pad), ["kind"], [F.col("step"), F.col("label")])
    return out.select("kind", "label", (F.col("rn") - 1).alias("idx"))


def projection_yield(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows, rows with a slot, slots expected and found.  ``df``: ``n_expected, tags``."""
    found = F.size(begin_tags(F.col("tags")))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(found > 0).alias("n_with_slots"),
        F.sum(F.col("n_expected").cast("bigint")).alias("n_expected"),
        F.sum(found.cast("bigint")).alias("n_found"),
    )
    return out.withColumn("found_pct", ratio(F.col("n_found"), F.col("n_expected"), 100.0))


def fix_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Before/after report of a re-projection.  ``df``: ``tags_before, tags, tokens``."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("tags_before") != F.col("tags")).alias("n_changed"),
        F.count_if(F.size("tokens") != F.size("tags")).alias("n_mismatched"),
        F.sum(F.size(begin_tags(F.col("tags_before"))).cast("bigint")).alias("slots_before"),
        F.sum(F.size(begin_tags(F.col("tags"))).cast("bigint")).alias("slots_after"),
    )


def slot_fillers(df: DataFrame, tokens: str, tags: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Distinct ``(slot, value)`` found in the annotation, as rows.

    Only spans opened by a B- tag count, as an I- without one fills no slot.
    """
    opened = F.filter(
        spans(F.col(tags)), lambda s: F.get(F.col(tags), s["start"]).startswith("B-")
    )
    rows = unnest(df, [tokens], opened, "_s")
    out = rows.select(F.col("_s.label").alias("slot"), span_text(F.col(tokens), F.col("_s")).alias("value"))
    return out.where(~F.col("slot").isin(list(exclude))).distinct()


def inventory_stats(df: DataFrame, duration: str, size: str, by: list[str]) -> DataFrame:
    """Durations: min, max, mean, median, sample deviation, hours; bytes in total."""
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.min(duration).alias("min_s"),
        F.max(duration).alias("max_s"),
        F.avg(duration).alias("mean_s"),
        F.stddev_samp(duration).alias("stdev_s"),
        (F.sum(duration) / 3600.0).alias("hours"),
        F.sum(size).alias("bytes"),
    )
    return base.join(exact_percentiles(df, by, duration, {"median_s": 50}), by)


def opener_error_rate(df: DataFrame, text: str, error: str, n: int = 15) -> DataFrame:
    """Per first word: errors, rows, rate; the n words with most errors."""
    rows = df.groupBy(opener(F.col(text)).alias("opener")).agg(
        F.sum(F.col(error).cast("bigint")).alias("n_errors"), F.count(F.lit(1)).alias("n_rows")
    )
    rows = rows.where("n_errors > 0").withColumn("rate", ratio(F.col("n_errors"), F.col("n_rows")))
    return rows.orderBy(F.desc("n_errors"), "opener").limit(n)


def compare_targets(df: DataFrame, targets: DataFrame, on: list[str], tol: int = 5) -> DataFrame:
    """Counts ``n`` against published ``target``: difference and OK / MISMATCH."""
    out = targets.join(df, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("diff", F.col("n") - F.col("target"))
    return out.withColumn("status", F.when(F.abs("diff") <= tol, "OK").otherwise("MISMATCH"))


def tag_quality(df: DataFrame, by: list[str], tags: str, entity: str) -> DataFrame:
    """Rows without any slot, and those of them that name an entity."""
    none = F.size(begin_tags(F.col(tags))) == 0
    named = F.trim(F.coalesce(F.col(entity), F.lit(""))) != ""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(none).alias("n_all_o"),
        F.count_if(none & named).alias("n_entity_all_o"),
    )


def empty_texts(df: DataFrame, by: list[str], text: str) -> DataFrame:
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(blank).alias("n_empty")
    )


def slot_histogram(df: DataFrame, tags: str) -> DataFrame:
    """Slot types by number of B- tags."""
    b = unnest(df, [], begin_tags(F.col(tags)), "tag")
    return b.groupBy(F.substring("tag", 3, 2147483647).alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )


def multi_slot_rows(df: DataFrame, by: list[str], tags: str) -> DataFrame:
    """Rows with two slots or more."""
    k = F.size(begin_tags(F.col(tags)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(k >= 2).alias("n_multi")
    )


def first_word_diversity(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """Distinct first words per group, through a first grouping on the word."""
    w = opener(F.col(text))
    words = df.groupBy(*by, w.alias("_w")).agg(F.count(F.lit(1)).alias("_n"))
    return words.groupBy(*by).agg(
        F.count_if(F.col("_w") != "").alias("n_first_words"), F.sum("_n").alias("n_rows")
    )


def keyword_share(df: DataFrame, by: list[str], text: str, keywords: list[str]) -> DataFrame:
    """Percentage of rows whose lower-cased text holds one of the keywords."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return df.groupBy(*by).agg(
        F.count_if(hit).alias("n_hits"), (F.avg(hit.cast("int")) * 100.0).alias("share_pct")
    )
