"""Order-dependent work that does not put a whole group into one task.

A plain window over a group sorts that group in a single task, which fails when one
class, language or speaker holds a third of all rows.  Here a group is cut into
*cells* along the wanted order: the rows of one cell are windowed together, and the
small table of cell totals gives every cell its offset.  The result equals the plain
window exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.session import sized

ORDER_CELLS = 3  # hex digits of the hash used as cell: 4096 cells per group


def hash_of(seed: int | str, *keys: Column | str) -> Column:
    """``md5(seed:key[:key...])``: an order that no partitioning can change."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    cell: Column,
    value: Column | None = None,
    cum: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Add the running sum of ``value`` (default: the row number) inside each group.

    ``cell`` must never decrease along ``order``.  One shuffle of the rows, on (group,
    cell); the offsets are a window over one row per cell.
    """
    value = F.lit(1).cast("bigint") if value is None else value
    keyed = df.withColumn("_k", F.struct(*[F.col(c) for c in by], cell.alias("_cell")))
    cells = keyed.groupBy("_k").agg(F.sum(value).alias("_cell_sum"))
    groups = [F.col(f"_k.{c}") for c in by]
    before = W.partitionBy(*groups).orderBy("_k._cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(
        "_k",
        F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_before"),
        F.sum("_cell_sum").over(W.partitionBy(*groups)).alias("_total"),
    )
    inside = W.partitionBy("_k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = keyed.withColumn("_in_cell", F.sum(value).over(inside)).join(offsets, "_k")
    out = out.withColumn(cum, F.col("_before") + F.col("_in_cell"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_k", "_in_cell", "_before", "_total")


def ranked(df: DataFrame, by: list[str], key: list[str], seed: int | str, rn="rn", total=None):
    """Row number (from 1) of each row in its group, in seeded hash order."""
    h = df.withColumn("_h", hash_of(seed, *key))
    out = running(
        h,
        by,
        [F.col("_h"), *[F.col(k) for k in key]],
        F.substring("_h", 1, ORDER_CELLS),
        cum=rn,
        total=total,
    )
    return out.drop("_h")


def within_rank(
    df: DataFrame,
    by: list[str],
    key: list[str],
    seed: int | str,
    cuts: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Add one boolean per cut: is the row among the first ``cut(n)`` of its group of n, in
    seeded hash order?

    The rows themselves are never shuffled.  The cell counts say in which cell each cut
    falls; only the keys of that cell (one in 4096) are ranked, to find the last hash that
    is in.  That threshold, one row per group, is joined back.
    """
    h = hash_of(seed, *key)
    place = F.struct(h.alias("h"), *[F.col(k) for k in key])
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("_g")
    slim = df.select(group, place.alias("_place"), F.substring(h, 1, ORDER_CELLS).alias("_cell"))
    cells = slim.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_c"))
    upto = W.partitionBy("_g").orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("_c").over(upto)).withColumn(
        "_n", F.sum("_c").over(W.partitionBy("_g"))
    )
    before = F.col("_upto") - F.col("_c")
    wanted = [
        F.struct(F.lit(name).alias("name"), (cut(F.col("_n")) - before).cast("bigint").alias("rank"))
        for name, cut in cuts.items()
    ]
    hit = F.filter(F.array(*wanted), lambda w: (w["rank"] >= 1) & (w["rank"] <= F.col("_c")))
    hit = cells.select("_g", "_cell", hit.alias("_hit")).where(F.size("_hit") > 0)
    inside = slim.join(hit, ["_g", "_cell"])
    w = W.partitionBy("_g", "_cell").orderBy("_place")
    inside = inside.withColumn("_rank", F.row_number().over(w))
    ends = [
        F.max(
            F.when(F.exists("_hit", _is_cut(name)), F.col("_place"))
        ).alias(f"_end_{name}")
        for name in cuts
    ]
    ends = inside.groupBy("_g").agg(*ends)
    # A cut at or above n leaves no threshold in any cell: everything is in.
    full = cells.groupBy("_g").agg(F.max("_n").alias("_n"))
    full = full.select("_g", *[(c(F.col("_n")) >= F.col("_n")).alias(f"_all_{m}") for m, c in cuts.items()])
    # Of known size: with few groups Spark broadcasts it and the rows of df stay where they are.
    ends = sized(full.join(ends, "_g", "left"), "cuts")
    out = df.withColumn("_g", group).withColumn("_place", place).join(ends, "_g")
    for name in cuts:
        under = F.coalesce(F.col("_place") <= F.col(f"_end_{name}"), F.lit(False))
        out = out.withColumn(name, F.col(f"_all_{name}") | under)
    return out.select(*df.columns, *cuts)


def _is_cut(name: str) -> Callable[[Column], Column]:
    return lambda w: (w["name"] == name) & (w["rank"] == F.col("_rank"))


def seeded_order(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Seeded shuffle: a total order, written out by a distributed range sort."""
    h = df.withColumn("_h", hash_of(seed, *key))
    return h.orderBy("_h", *key).drop("_h")


def sequence_ids(df: DataFrame, order: str, chunk: int = 100_000, rn="rn") -> DataFrame:
    """Row number over a whole table ordered by a unique non-negative integer column."""
    return running(df, [], [F.col(order)], F.expr(f"{order} div {chunk}"), cum=rn)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key.  An aggregate, so copies merge on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}") for c in rest]).select(*df.columns)


def most_common(df: DataFrame, by: list[str], n: int, count: str = "n") -> DataFrame:
    """The n most frequent values, ties by value."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))
    return counts.orderBy(F.desc(count), *by).limit(n)


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def numbered(df: DataFrame, by: list[str], order: list[Column], rn: str = "rn") -> DataFrame:
    """Row number (from 1) inside each group along ``order``, which has no ties inside a group.

    Spark's range partitioning samples bounds of the full key, so neither a group that holds
    most rows nor a prefix that all keys share leaves a large task.  The range of each row is
    stored with it: bounds sampled again after a loss could cut elsewhere.
    """
    ranges = df.repartitionByRange(*[F.col(c) for c in by], *order)
    ranges = sized(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    return running(ranges, by, order, F.col("_range"), cum=rn).drop("_range")


#: Accuracy of the percentile sketch: a wanted rank is known to one ten-thousandth of the rows.
SKETCH = 10_000
#: How far from a wanted rank its two bounds are asked for, in shares of the group.
AROUND = 3 / SKETCH


def around_ranks(src: DataFrame, ranks: list[float]) -> DataFrame:
    """``(_g, _n, _p, _c)``: how often each value ``_x`` around the wanted ranks of a group occurs,
    and how many rows lie in each stretch between; ``_p`` is (stretch, value or null), in order.

    A mergeable sketch per group gives two values around each rank (a share of 0..1); a
    second pass counts.  Groups of up to ``SKETCH`` rows, where neighbouring ranks are less
    than the sketch's error apart, keep all values.
    """
    shares = [min(max(r + d, 0.0), 1.0) for r in ranks for d in (-AROUND, AROUND)]
    bounds = src.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_x", F.array(*[F.lit(s) for s in shares]), F.lit(SKETCH)).alias("_b"),
    )
    # Of known size: with few groups Spark broadcasts it and the rows of src stay where they are.
    bounds = sized(bounds, "bounds")
    v, b = F.col("_x"), F.col("_b")
    inside = F.col("_n") <= SKETCH
    stretch = F.lit(0)
    for i, (lo, hi) in enumerate(zip(shares[::2], shares[1::2], strict=True)):
        above = v >= b[2 * i] if lo > 0 else F.lit(True)
        below = v <= b[2 * i + 1] if hi < 1 else F.lit(True)
        inside = inside | (above & below)
        stretch = stretch + (v > b[2 * i]).cast("int") + (v > b[2 * i + 1]).cast("int")
    # Within one stretch everything outside the bounds comes before what equals the next bound.
    place = F.struct(stretch.alias("s"), F.when(inside, v).alias("x"))
    return src.join(bounds, "_g").groupBy("_g", "_n", place.alias("_p")).agg(
        F.count(F.lit(1)).alias("_c")
    )


def exact_percentiles(
    df: DataFrame, by: list[str], x: str, ps: dict[str, float], kind: str = "linear"
) -> DataFrame:
    """Exact percentiles per group for groups of any size and any distribution.

    ``ps`` maps output column to percentile in 0..100.  ``kind='linear'`` interpolates
    on rank ``(n - 1) * p / 100``; ``'index'`` takes the element at ``floor(n * p / 100)``.
    Null values do not count; a group without others is not in the result.

    What is sorted is about a thousandth of a group for each percentile, however narrow the
    range its values are in.  Should the sketch ever miss its documented error by more than
    three times, the query fails; it never returns another value.
    """
    group = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("_g")
    src = df.where(F.col(x).isNotNull()).select(group, F.col(x).cast("double").alias("_x"))
    # Stored, as its stretches are counted before its values are ranked.
    counts = sized(around_ranks(src, [p / 100.0 for p in ps.values()]), "around")
    cum = running(counts, ["_g"], [F.col("_p")], F.col("_p.s"), F.col("_c"), "_cum")
    value = F.col("_p.x")
    picks, outs = [], []
    for name, p in ps.items():
        share = F.lit(float(p)) / 100.0
        if kind == "linear":
            rank = (F.col("_n") - 1) * share
        else:
            rank = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
        lo = F.floor(rank)
        hi = F.least(lo + 1, F.col("_n") - 1)
        for tag, r in (("lo", lo), ("hi", hi)):
            here = (r >= F.col("_cum") - F.col("_c")) & (r < F.col("_cum"))
            missed = F.raise_error(F.lit("a percentile lies outside the bounds of its sketch"))
            found = F.when(value.isNotNull(), value).otherwise(missed.cast("double"))
            picks.append(F.max(F.when(here, found)).alias(f"_{tag}_{name}"))
        picks.append(F.max(rank - lo).alias(f"_w_{name}"))
        a, z = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((a + (z - a) * F.col(f"_w_{name}")).alias(name))
    return cum.groupBy("_g").agg(*picks).select(*[F.col("_g")[c].alias(c) for c in by], *outs)
