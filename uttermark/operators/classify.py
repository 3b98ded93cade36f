"""Intent classifiers trained for all experiment cells at once.

Multinomial naive Bayes with add-one smoothing is counting, so it stays in the DataFrame
engine: one aggregation for the model, one join and one aggregation for the scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.util import unnest
from uttermark.operators import logistic
from uttermark.operators.match import overlap_partition
from uttermark.operators.metrics import accuracy
from uttermark.session import sized

def nb_counts(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Word counts ``(cell, class, tok, c)`` and class sizes ``(cell, class, n_docs)``.

    ``train``: ``cells array<string>, class, tokens array<string>``.  Rows with the same
    list of cells are counted together first; the lists are opened on the counts.
    """
    words = unnest(train, ["cells", "class"], F.col("tokens"), "tok")
    w = words.groupBy("cells", "class", "tok").agg(F.count(F.lit(1)).alias("c"))
    w = w.select(F.explode("cells").alias("cell"), "class", "tok", "c")
    w = w.groupBy("cell", "class", "tok").agg(F.sum("c").alias("c"))
    d = train.groupBy("cells", "class").agg(F.count(F.lit(1)).alias("n"))
    d = d.select(F.explode("cells").alias("cell"), "class", "n")
    return w, d.groupBy("cell", "class").agg(F.sum("n").alias("n_docs"))


def nb_predict(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``(cell, key, pred)`` for every test row and cell.

    score = log prior + sum over known words of log((c + 1) / (words of class + vocabulary)).
    A word the class has not seen adds nothing to the numerator, so only seen words are
    joined; the denominators enter by the number of known words.  Ties go to the smaller
    class name.  Training rows without a class do not count.
    """
    words, docs = nb_counts(train.where(F.col("class").isNotNull()))
    words = sized(words, "words")  # used three times below
    size = words.groupBy("cell").agg(F.count_distinct("tok").alias("v"))
    mass = words.groupBy("cell", "class").agg(F.sum("c").alias("t"))
    total = docs.groupBy("cell").agg(F.sum("n_docs").alias("n_cell"))
    prior = (
        docs.join(total, "cell").join(mass, ["cell", "class"], "left").join(size, "cell", "left")
        .select(
            "cell", "class",
            F.log(F.col("n_docs") / F.col("n_cell")).alias("prior"),
            F.log((F.coalesce("t", F.lit(0)) + F.coalesce("v", F.lit(0))).cast("double")).alias("denom"),
        )
    )
    # One row per cell with its classes; their numbers are set by the experiment, not the data.
    cells = prior.groupBy("cell").agg(
        F.array_sort(F.collect_list(F.struct("class", "prior", "denom"))).alias("_classes")
    )
    cells = sized(cells, "cells")
    one_row = cells.agg(F.collect_list("cell").alias("_cells"))

    # A word's weights in all cells and classes are one array, so a test word meets one row.  The
    # entry without a class counts the word as known in the cell.
    weight = F.struct("cell", "class", F.log((F.col("c") + 1).cast("double")).alias("w"))
    weights = words.groupBy("tok").agg(F.collect_list(weight).alias("_w"))
    known = F.transform(
        F.array_distinct(F.transform("_w", lambda e: e["cell"])),
        lambda c: F.struct(c.alias("cell"), F.lit(None).cast("string").alias("class"), F.lit(1.0).alias("w")),
    )
    weights = weights.select("tok", F.concat("_w", known).alias("_w"))
    bag = unnest(test, [key], F.col("tokens"), "tok").groupBy(key, "tok").agg(
        F.count(F.lit(1)).alias("_k")
    )
    hits = bag.join(weights, "tok").select(key, "_k", F.inline("_w"))
    hits = hits.groupBy(key, "cell", "class").agg(F.sum(F.col("_k") * F.col("w")).alias("_s"))
    hits = hits.groupBy(key, "cell").agg(
        F.max(F.when(F.col("class").isNull(), F.col("_s"))).alias("_known"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "_s")))
        ).alias("_sums"),
    )
    base = test.select(key).crossJoin(one_row).select(key, F.explode("_cells").alias("cell"))
    scored = base.join(hits, [key, "cell"], "left").join(cells, "cell")

    def score(c):
        seen = F.coalesce(F.try_element_at("_sums", c["class"]), F.lit(0.0))
        s = F.round(c["prior"] + seen - F.coalesce("_known", F.lit(0.0)) * c["denom"], 6)
        return F.struct((-s).alias("a"), c["class"].alias("b"))

    best = F.array_min(F.transform("_classes", score))["b"]
    return scored.select("cell", key, best.alias("pred"))


def intent_sweep(train: DataFrame, test: DataFrame, key: str, label: str = "class") -> DataFrame:
    """``cell, n_test, n_correct, accuracy``: every cell on the same test rows."""
    p = nb_predict(train, test.select(key, "tokens"), key).join(test.select(key, label), key)
    ok = F.col("pred") == F.col(label)
    return p.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(ok).alias("n_correct"),
        F.avg(ok.cast("int")).alias("accuracy"),
    )


def intent_sweep_logreg(
    train: DataFrame, test: DataFrame, cells: list[str]
) -> DataFrame:
    """The same table from logistic regression: all cells fitted in the same jobs, on counts of
    every word of the cell (no hashing, so no two words share a feature)."""
    return logistic.sweep(train, test, cells)


def partition_baseline(train: DataFrame, test: DataFrame, key: str, text: str) -> DataFrame:
    """Train on one corpus' text, test on another's: accuracy over test rows whose text is in
    the training corpus, over the novel ones, and over all (null part)."""
    one = train.withColumn("cells", F.array(F.lit("all")))
    p = nb_predict(one, test.select(key, "tokens"), key).select(key, "pred")
    parts = overlap_partition(test.select(key, text, "class"), train, text)
    joined = parts.join(p, key).withColumn("ok", F.col("pred") == F.col("class"))
    return accuracy(joined, "part", "ok")
