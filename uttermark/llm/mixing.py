"""Mixing sources to target weights by weighted sampling without replacement.

Every row draws an exponential key, divided by its quality weight; rows with small keys are taken
first (Efraimidis and Spirakis).  Within a source the keys are sorted and the sizes summed up to
the source's budget.  A budget above the size of the source first takes whole epochs.

Sorting a source of any size in one task is avoided: keys fall into cells, the cells' sums say in
which cell the budget ends, and only the rows of that one cell are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from uttermark.llm.common import fresh, stored, word_count

CELLS = 4096
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1]: less for texts with many symbols; 1 for null and empty texts."""
    n = F.length(text)
    symbols = n - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.lit(1.0) / (1.0 + 8.0 * symbols / F.greatest(n, F.lit(1))), F.lit(1.0))


def exponential_key(identity: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u drawn from a hash, so that reruns and retried tasks agree."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), identity)), 1, 13), 16, 10)
    u = (digits.cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(
    totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """``target`` per source from ``source`` and ``source_size`` (one row per source).

    The sources in order (null last) have the weights in turn.  They divide ``share`` times the
    whole size, none more than ``most`` times its own; what is left over goes to the others.
    Sorted by cap over weight, the capped sources come first, so one running sum finds them.
    """
    everything = W.Window.partitionBy()
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    d = totals.select(
        "*",
        F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).alias("_w"),
        (F.col("source_size") * most).alias("_cap"),
        (F.sum("source_size").over(everything) * share).alias("_budget"),
    )
    fill = W.Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    so_far = fill.rowsBetween(W.Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, W.Window.unboundedFollowing)
    d = d.withColumn(
        "_level",
        (F.col("_budget") - F.coalesce(F.sum("_cap").over(so_far), F.lit(0.0))) / F.sum("_w").over(rest),
    ).withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_level"))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(level["_level"] * F.col("_w"))
    return d.select("source", "source_size", target.alias("target"))


def sized(docs: DataFrame, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id") -> list[Column]:
    """The columns that the mix needs of a row: source, size, key.

    Rows without an id are told apart by their text.
    """
    identity = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.col(text)), F.lit(""))
    draw = exponential_key(identity, quality_weight(F.col(text)), seed)
    return [F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw.alias("draw")]


def cell_of(draw: Column) -> Column:
    """The cell of a key; grows with the key."""
    return F.floor((1.0 - F.exp(-draw)) * CELLS).cast("int")


def mix_cuts(rows: DataFrame, **shares) -> DataFrame:
    """Per source: size, target, whole ``epochs``, and the last cell and key of the fraction.

    ``rows`` has ``source``, ``size``, ``draw``.  A row is in the fraction if its key is at most
    ``cut``; the row at the border is taken if at least half of it fits.  Equal keys go together.
    """
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, **shares)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * size)
    targets = stored(targets, "mix-targets")

    cells = rows.groupBy("source", cell_of(F.col("draw")).alias("cell")).agg(F.sum("size").alias("cell_size"))
    upto = W.Window.partitionBy("source").orderBy("cell")
    cells = cells.withColumn("before", F.sum("cell_size").over(upto) - F.col("cell_size"))
    border = (
        cells.withColumnRenamed("source", "_source")
        .join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .where((F.col("cell_size") > 0) & (F.col("before") <= F.col("rest")))
        .groupBy("source", "source_size", "target", "epochs", "rest")
        .agg(F.max("cell").alias("cell"), F.max("before").alias("before"))
    )
    border = stored(border, "mix-border")
    inside = (
        rows.withColumnRenamed("source", "_source")
        .withColumn("_cell", cell_of(F.col("draw")))
        .join(border, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_cell") == F.col("cell")))
        .groupBy("source", "before", "rest", "draw")
        .agg(F.sum("size").alias("size"))
    )
    in_order = W.Window.partitionBy("source").orderBy("draw")
    last = (
        inside.withColumn("at", F.col("before") + F.sum("size").over(in_order) - F.col("size") / 2)
        .where(F.col("at") <= F.col("rest"))
        .groupBy("source")
        .agg(F.max("draw").alias("cut"))
    )
    last = last.withColumnRenamed("source", "_source")
    # Sources without a word have no border; they take nothing.
    known = border.select("source", "cell").withColumnsRenamed({"source": "_known", "cell": "_at"})
    return (
        targets.join(known, F.col("source").eqNullSafe(F.col("_known")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
        .select("source", "source_size", "target", "epochs", F.coalesce("_at", F.lit(-1)).alias("cell"), "cut")
    )


def copies(draw: Column) -> Column:
    """How often a row is taken, given its source's row of ``mix_cuts``."""
    cell = cell_of(draw)
    more = (cell < F.col("cell")) | ((cell == F.col("cell")) & (draw <= F.col("cut")))
    return F.col("epochs") + F.coalesce(more, F.lit(False)).cast("int")


def taken(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    Null and empty texts have size 0 and take nothing; a null source is a source of its own, the
    last; repeated rows share a key and are taken together; an empty table gives no rows.  Only
    ``doc_id``, ``text`` and ``source`` are looked at, further columns are left out.
    """
    rows = stored(docs.select("doc_id", *sized(docs, seed)), "mix-rows")
    cuts = stored(mix_cuts(rows, **shares), "mix-cuts").withColumnRenamed("source", "_source")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("draw"))).alias("taken"),
        "source",
        (F.when(F.col("size") > 0, copies(F.col("draw"))).otherwise(0)).alias("copies"),
    )


def mixed(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, all columns kept.

    Rows without words are not part of a mix.
    """
    cuts = stored(mix_cuts(stored(docs.select(*sized(docs, seed)), "mix-rows"), **shares), "mix-cuts")
    names = dict(zip(cuts.columns, fresh(docs, *[f"mix_{c}" for c in cuts.columns]), strict=True))
    source, size, draw = sized(docs, seed)
    (a, b, times) = fresh(docs, "mix_size", "mix_draw", "mix_times")
    d = docs.withColumns({a: size, b: draw})
    cuts = cuts.withColumnsRenamed(names)
    on = F.col("source").eqNullSafe(F.col(names["source"]))
    cell = cell_of(F.col(b))
    more = (cell < F.col(names["cell"])) | (
        (cell == F.col(names["cell"])) & (F.col(b) <= F.col(names["cut"]))
    )
    n = F.col(names["epochs"]) + F.coalesce(more, F.lit(False)).cast("int")
    return (
        d.join(cuts, on)
        .where(F.col(a) > 0)
        .withColumn(times, F.explode(F.array_repeat(F.lit(1), n)))
        .select(*docs.columns)
    )


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'text ' || text, '')), 1, 13))::BIGINT + 0.5)
        / 4503599627370496.0)
      / coalesce(1.0::DOUBLE / (1.0::DOUBLE + 8.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', '')))
        / greatest(length(text), 1)), 1.0) AS draw
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM totals),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
      ELSE w * min_by(level, cap / w) FILTER (cap > level * w) OVER () END AS target
  FROM levels),
placed AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(b.size) OVER (PARTITION BY b.source ORDER BY b.draw) - b.size / 2.0 AS middle
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
