"""Evaluation: accuracy, confusion, precision / recall / F1, folds and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions.tags import spans
from uttermark.functions.util import f_score, ratio, unnest


def norm_label(c: Column) -> Column:
    return F.lower(F.trim(c))


def accuracy(df: DataFrame, by: str, correct: str) -> DataFrame:
    """``tp, n, accuracy`` per class and over all rows; ``is_total`` marks the latter, as a
    class may be null too."""
    ok = F.col(correct).cast("int")
    sums = df.groupBy(by).agg(F.sum(ok).alias("tp"), F.count(F.lit(1)).alias("n"))
    # The rollup runs over one row per class, not over the corpus.
    total = (F.grouping(by) == 1).alias("is_total")
    out = sums.rollup(by).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), total)
    return out.withColumn("accuracy", ratio(F.col("tp"), F.col("n")))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Wrong predictions only, counted by (gold, pred); a missing one shows as 'None'."""
    p = F.coalesce(F.col(pred), F.lit("None"))
    wrong = df.select(F.col(gold).alias("gold"), p.alias("pred")).where("gold <> pred")
    return wrong.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def with_prf(df: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to ``tp, fp, fn``; 0.0 on an empty denominator."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return out.withColumn("f1", f_score(F.col("precision"), F.col("recall")))


def prf_by_class(df: DataFrame, gold: str, pred: str, cell: list[str] = ()) -> DataFrame:
    """Per class and micro (``is_total``): tp, fp, fn and scores.

    A wrong row is a miss of its gold class and a false hit of the predicted class; a
    null prediction is only a miss.  ``cell`` columns keep experiments apart.
    """
    pairs = df.groupBy(*cell, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    same = F.col("_g").eqNullSafe(F.col("_p"))
    zero, n = F.lit(0).cast("bigint"), F.col("_n")
    arms = F.array(
        F.struct(
            F.col("_g").alias("class"),
            F.when(same, n).otherwise(zero).alias("tp"),
            zero.alias("fp"),
            F.when(same, zero).otherwise(n).alias("fn"),
        ),
        F.when(
            ~same & F.col("_p").isNotNull(),
            F.struct(F.col("_p").alias("class"), zero.alias("tp"), n.alias("fp"), zero.alias("fn")),
        ),
    )
    rows = unnest(pairs, list(cell), arms, "_a")
    return _rolled(rows.select(*cell, "_a.*"), cell, "class")


def _rolled(rows: DataFrame, cell: list[str], cls: str) -> DataFrame:
    """Sums per class and over all classes (``is_total``), from one pass over the rows."""
    per = rows.groupBy(*cell, cls).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    both = per.groupingSets([[*cell, cls], [*cell]], *cell, cls)
    total = (F.grouping(cls) == 1).alias("is_total")
    return with_prf(both.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], total))


def span_f1(df: DataFrame, gold: str, pred: str, cell: list[str] = ()) -> DataFrame:
    """Span scores per slot type and overall (``is_total``), with the support.

    A span counts when start, end and type agree.  Both tag lists are in one row, so
    the comparison is a set operation inside the row; only the counts are shuffled.
    """
    d = df.select(*cell, span_keys(F.col(gold)).alias("_g"), span_keys(F.col(pred)).alias("_p"))
    hits = F.transform(F.array_intersect("_g", "_p"), _count_as(1, 0, 0))
    false = F.transform(F.array_except("_p", "_g"), _count_as(0, 1, 0))
    missed = F.transform(F.array_except("_g", "_p"), _count_as(0, 0, 1))
    rows = unnest(d, list(cell), F.concat(hits, false, missed), "_a").select(*cell, "_a.*")
    out = _rolled(rows, cell, "label")
    return out.withColumn("support", F.col("tp") + F.col("fn"))


def span_keys(tags: Column) -> Column:
    """Spans as strings ``start:end:label``, which set operations can hash."""
    return F.transform(spans(tags), lambda s: F.concat_ws(":", s["start"], s["end"], s["label"]))


def _count_as(tp: int, fp: int, fn: int):
    def one(key: Column) -> Column:
        return F.struct(
            F.get(F.split(key, ":", 3), F.lit(2)).alias("label"),
            F.lit(tp).cast("bigint").alias("tp"),
            F.lit(fp).cast("bigint").alias("fp"),
            F.lit(fn).cast("bigint").alias("fn"),
        )

    return one


def slot_recall(bags: DataFrame, by: str) -> DataFrame:
    """From the result of ``bag_match`` with the row's key and ``by``: recall per group and
    the rows with any slot error."""
    per_row = bags.groupBy("utt_id", by).agg(
        F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp")
    )
    return per_row.groupBy(by).agg(
        ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("slot_recall"),
        F.count_if((F.col("fn") > 0) | (F.col("fp") > 0)).alias("n_rows_with_error"),
    )


def fold_summary(
    metrics: DataFrame, baseline: str, added: DataFrame | None = None
) -> DataFrame:
    """Mean and population deviation of each metric over folds or seeds, difference to the
    baseline experiment in percentage points, and that per added row.

    ``metrics``: ``experiment, fold, metric, value``; ``added``: ``experiment, n_added``.
    """
    s = metrics.groupBy("experiment", "metric").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count(F.lit(1)).alias("n_folds"),
    )
    base = s.where(F.col("experiment") == baseline).select("metric", F.col("mean").alias("_base"))
    out = s.join(base, "metric", "left")
    out = out.withColumn("delta_pp", (F.col("mean") - F.col("_base")) * 100.0).drop("_base")
    if added is not None:
        out = out.join(added, "experiment", "left")
        per = F.when(F.col("n_added") > 0, F.col("delta_pp") / F.col("n_added"))
        out = out.withColumn("delta_pp_per_row", per)
    return out


def compare_sides(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Real against synthetic side by side, difference in percentage points; 'n/a' where a
    side is missing.  ``metrics``: keys, ``side, value``."""
    wide = metrics.groupBy(*keys).pivot("side", ["real", "synthetic"]).agg(F.max("value"))
    delta = (F.col("real") - F.col("synthetic")) * 100.0
    shown = F.coalesce(F.format_string("%+.2f", F.round(delta, 2)), F.lit("n/a"))
    text = F.when(delta.isNull(), "n/a").otherwise(shown)
    return wide.withColumn("delta_pp", delta).withColumn("shown", text)


def best_epoch(metrics: DataFrame, by: list[str], value: str, epoch: str) -> DataFrame:
    """Best value over the epochs and the first epoch that reached it.

    This picks the epoch by the very set it reports on, which ``selected_on_test`` says.
    """
    return metrics.groupBy(*by).agg(
        F.max(value).alias("best"),
        F.min_by(epoch, F.struct((-F.col(value)).alias("v"), F.col(epoch).alias("e"))).alias("epoch"),
        F.lit(True).alias("selected_on_test"),
    )
