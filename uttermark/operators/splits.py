"""Leak-free splits and samples.

Every choice is a rank in seeded hash order (see ``order``): it does not depend on
partitioning, sizes are exact, and a class of any size is ranked in parallel.  Where a
choice is a cut of that order, ``within_rank`` finds it from the keys, and the rows (with
their texts) are only filtered, never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.operators.order import ranked, within_rank

def group_split(
    df: DataFrame, key: str, sizes: tuple[int, int, int], seed: int = 42, exact: bool = False
) -> DataFrame:
    """Add ``split`` by whole groups: every row of one key goes to the same split.

    ``sizes`` are train, dev and test in groups, taken as ratios: dev and test get their
    share of the groups there are (at least 1 each), train all others.  With ``exact``
    and enough groups the sizes are met to the group, and the surplus groups are marked
    ``unused``.
    """
    train, dev, test = sizes
    total = train + dev + test
    keys = df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key).distinct()
    r = ranked(keys, [], [key], seed, "_rn", "_n")
    have = F.col("_n")
    share = {
        name: F.when((have >= total) & F.lit(exact), F.lit(size)).otherwise(
            F.greatest(F.lit(1), F.floor(have * F.lit(size) / F.lit(float(total))))
        )
        for name, size in (("dev", dev), ("test", test))
    }
    split = (
        F.when(F.lit(exact) & (F.col("_rn") > total), "unused")
        .when(F.col("_rn") <= share["test"], "test")
        .when(F.col("_rn") <= share["test"] + share["dev"], "dev")
        .otherwise("train")
    )
    parts = r.select(key, split.alias("split"))
    return df.join(parts, key)


def low_resource_cut(df: DataFrame, config: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Cut (lang, split) cells to their target after dropping the excluded intent.

    ``config``: ``lang, split, target, excluded``; cells it does not name stay whole.
    """
    c = config.select("lang", "split", "target", F.lower("excluded").alias("_excluded"))
    d = df.join(c, ["lang", "split"], "left")
    out = F.lower("intent") == F.col("_excluded")
    d = d.where(~F.coalesce(out, F.lit(False)))
    whole = d.where(F.col("target").isNull())
    by = ["lang", "split", "target"]
    cut = within_rank(d.where(F.col("target").isNotNull()), by, key, seed, {"_in": _target})
    return whole.unionByName(cut.where("_in").drop("_in")).drop("target", "_excluded")


def _target(n: Column) -> Column:
    return F.least(n, F.col("_g.target").cast("bigint"))


def stratified_split(
    df: DataFrame, by: list[str], key: list[str], ratio: float = 0.885, seed: int | str = 42
) -> DataFrame:
    """Add ``split``: the first ``floor(n * ratio)`` rows of each class are train."""
    r = within_rank(df, by, key, seed, {"_in": lambda n: F.floor(n * F.lit(ratio))})
    return r.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def fraction_size(n: Column, f: float) -> Column:
    """Rows kept of a class of n under a fraction: at least one, none at f <= 0."""
    if f <= 0:
        return F.lit(0).cast("bigint")
    if f >= 1:
        return n
    return F.greatest(F.lit(1), F.bround(n * F.lit(f)).cast("bigint"))


def stratified_fraction(
    df: DataFrame, by: list[str], key: list[str], f: float, seed: int | str = 42
) -> DataFrame:
    r = within_rank(df, by, key, seed, {"_in": lambda n: fraction_size(n, f)})
    return r.where("_in").drop("_in")


def stratified_kfold(
    df: DataFrame, by: list[str], key: list[str], k: int = 5, seed: int | str = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1, dealt round robin inside each class."""
    r = ranked(df, by, key, seed, "_rn")
    return r.withColumn("fold", F.pmod(F.col("_rn") - 1, F.lit(k))).drop("_rn")


def stratified_n(
    df: DataFrame, by: list[str], key: list[str], n: int, seed: int | str = 42, floor: int = 0
) -> DataFrame:
    """Down-sample to about n rows in proportion to the classes, each at least ``floor``."""
    total = df.agg(F.count(F.lit(1)).alias("_all"))  # one row

    def size(c: Column) -> Column:
        want = F.bround(c / F.col("_g._all") * n).cast("bigint")
        return F.least(c, F.greatest(want, F.lit(floor)))

    r = within_rank(df.crossJoin(total), [*by, "_all"], key, seed, {"_in": size})
    return r.where("_in").drop("_in", "_all")


def holdout(
    df: DataFrame, by: list[str], key: list[str], test: float = 0.2, seed: int | str = 42
) -> DataFrame:
    """The stratified hold-out that all experiments share: same seed, same test set."""
    return stratified_split(df, by, key, 1.0 - test, f"holdout-{seed}")


def dev_holdout(df: DataFrame, key: list[str], f: float = 0.1, seed: int | str = 42) -> DataFrame:
    """Add ``split``: ``max(1, floor(n * f))`` rows become dev, the rest train."""
    n_dev = {"_in": lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(f)))}
    r = within_rank(df, [], key, seed, n_dev)
    return r.withColumn("split", F.when(F.col("_in"), "dev").otherwise("train")).drop("_in")


def cell_name(ratio: float) -> str:
    return f"{ratio:.2f}"


def ratio_sweep(
    real: DataFrame,
    synth: DataFrame,
    ratios: list[float],
    by: list[str],
    key: list[str],
    seed: int | str = 42,
) -> DataFrame:
    """Tag each row with the sweep cells it belongs to, in one pass.

    Cell ``r`` is all synthetic rows and the fraction r of the real rows per class;
    ``real_only`` is all real rows.  Membership is an array column ``cells``, so the
    corpus is not copied per cell; explode it as late as possible.  One ranking serves
    all ratios, so smaller cells are contained in larger ones.
    """
    marks = {f"_in{i}": _share(f) for i, f in enumerate(ratios)}
    r = within_rank(real, by, key, seed, marks)
    inside = [F.when(F.col(m), F.lit(cell_name(f))) for m, f in zip(marks, ratios, strict=True)]
    cells = F.filter(F.array(*inside, F.lit("real_only")), lambda c: c.isNotNull())
    tagged = r.withColumn("cells", cells).drop(*marks).withColumn("origin", F.lit("real"))
    every = F.array(*[F.lit(cell_name(f)) for f in ratios])
    s = synth.withColumn("cells", every).withColumn("origin", F.lit("synthetic"))
    return tagged.unionByName(s)


def _share(f: float):
    return lambda n: fraction_size(n, f)


def cell_sizes(sweep: DataFrame) -> DataFrame:
    """Rows per cell: total, real, synthetic.  Counts per membership list come first."""
    lists = sweep.groupBy("cells", "origin").agg(F.count(F.lit(1)).alias("n"))
    rows = lists.select(F.explode("cells").alias("cell"), "origin", "n")
    is_real = F.col("origin") == "real"
    return rows.groupBy("cell").agg(
        F.sum("n").alias("n_train"),
        F.sum(F.when(is_real, F.col("n")).otherwise(0)).alias("n_real"),
        F.sum(F.when(~is_real, F.col("n")).otherwise(0)).alias("n_synthetic"),
    )


def sample_n(df: DataFrame, key: list[str], n: int, seed: int | str = 42) -> DataFrame:
    """Uniform sample of n rows."""
    cut = {"_in": lambda total: F.least(total, F.lit(n))}
    return within_rank(df, [], key, seed, cut).where("_in").drop("_in")


def assert_no_leak(refs: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """One row: references, and those of them whose key is in the test set (must be 0)."""
    t = test.select(key).distinct().withColumn("_leak", F.lit(True))
    return refs.join(t, key, "left").agg(
        F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("_leak")).alias("n_leaked")
    )


def fold_cells(df: DataFrame, k: int) -> DataFrame:
    """One row per (row, cell): cell c tests on fold c and trains on the others."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cell")
    out = df.select("*", cells)
    return out.withColumn("role", F.when(F.col("fold") == F.col("cell"), "test").otherwise("train"))
