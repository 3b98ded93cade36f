"""Quality rules: robust multivariate outliers among text statistics.

Per language and source, the minimum-covariance-determinant estimate of the statistics' centre and
scatter is found by concentration steps on all rows: the three quarters of the rows that lie
nearest are kept, centre and scatter are taken from them, and so on.  Rows whose Mahalanobis
distance is beyond a far quantile are rejected.

One step is one aggregate: distances fall into fine cells, each cell keeps counts, sums and
products, and the cells nearest to the centre that hold enough rows make up the kept part.  So no
group is ever sorted or gathered, however large.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from uttermark.llm.common import WORD, fresh, stored

MIN_WORDS = 50
KEEP = 0.75  # of a group's rows in a concentration step
ROUNDS = 6
MIN_ROWS = 50  # a smaller group is pooled
TAIL = 1e-5  # share of regular rows beyond the cut, were they normal
WEIGHT_AT = 0.975  # rows within this quantile make up the final estimate

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Transformed statistics, and the least standard deviation that each is given: clean texts
#: hardly vary in some of them, and small differences there mean nothing.
STATISTICS = {
    "word_length": 0.15,  # log of letters per word
    "symbols": 0.06,  # the others: square roots of shares
    "capitals": 0.08,
    "marks": 0.06,
    "repeated_lines": 0.15,
    "repeated_words": 0.12,
}
P = len(STATISTICS)
LEAST = np.array(list(STATISTICS.values()))
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

_word = re.compile(WORD)
_symbols = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_marks = np.frombuffer(b"!?.,;:|\"'()[]{}-_=+/\\~^@#*$%&<>", dtype=np.uint8)
_blanks = np.array([0x20, *range(0x09, 0x0E)])


def text_counts(text: str | None) -> tuple[list[int], list[float]]:
    """Base counts and transformed statistics of one text; null is no text."""
    words = _word.findall(text or "")
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * P
    by_byte = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    letters = int(by_byte[:128].sum() + by_byte[192:].sum() - by_byte[_blanks].sum())
    symbols = int(by_byte[_symbols].sum())
    lines = [x for x in text.split("\n") if _word.search(x)]
    dup_lines = len(lines) - len(set(lines))

    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n > 3:
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) > 1_500_000:  # keep products within 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[which] > 1
        inside = np.zeros(n, dtype=bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    statistics = [
        math.log(letters / n),
        math.sqrt(symbols / letters),
        math.sqrt(int(by_byte[65:91].sum()) / letters),
        math.sqrt(int(by_byte[_marks].sum()) / letters),
        math.sqrt(dup_lines / len(lines)),
        math.sqrt(repeated / n),
    ]
    return [n, letters, symbols, dup_lines, repeated], statistics


def with_counts(df: DataFrame, text: str, counts: list[str], statistics: str, drop: bool = False) -> DataFrame:
    """Append the base counts and the array of statistics; ``drop``: leave the text out."""
    kept = [f for f in df.schema.fields if not (drop and f.name == text)]
    new = [T.StructField(c, T.LongType()) for c in counts]
    schema = T.StructType([*kept, *new, T.StructField(statistics, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(text)
    keep = [i for i, c in enumerate(df.columns) if not (drop and c == text)]

    def run(batches):
        for batch in batches:
            made = [text_counts(t) for t in batch.column(at).to_pylist()]
            arrays = [pa.array([m[0][i] for m in made], type=pa.int64()) for i in range(len(counts))]
            arrays.append(pa.array([m[1] for m in made], type=pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)


# --- quantiles of the chi-square distribution -------------------------------------------------


def chi2_cdf(x: float, df: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail for an even number of degrees of freedom, exact also far out."""
    z, term, total = x / 2, 1.0, 1.0
    for k in range(1, df // 2):
        term *= z / k
        total += term
    return math.exp(-z) * total


def solve(f, target: float, low: float, high: float) -> float:
    """Where the falling or rising ``f`` takes the value ``target``."""
    rising = f(high) > f(low)
    for _ in range(200):
        mid = (low + high) / 2
        if (f(mid) < target) == rising:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def consistency(share: float) -> float:
    """What the scatter of the nearest ``share`` of normal rows is multiplied by."""
    q = solve(lambda x: chi2_cdf(x, P), share, 0.0, 500.0)
    return share / chi2_cdf(q, P + 2)


CUT = solve(lambda x: chi2_tail(x, P), TAIL, 0.0, 500.0)


# --- estimates ---------------------------------------------------------------------------------


def units(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang, source, unit``: the group whose estimate a row is judged by.

    A group of fewer than MIN_ROWS is pooled with the other small ones of its language; if they
    are still few, with those of all languages; if even these are few, the unit is null and the
    method rejects none of them.
    """
    g = rows.groupBy(F.col(lang).alias("lang"), F.col(source).alias("source")).agg(F.count("*").alias("n"))
    small = F.when(F.col("n") < MIN_ROWS, F.col("n"))
    g = g.withColumn("n_lang", F.sum(small).over(W.Window.partitionBy("lang")))
    left = F.when((F.col("n") < MIN_ROWS) & (F.col("n_lang") < MIN_ROWS), F.col("n"))
    g = g.withColumn("n_all", F.sum(left).over(W.Window.partitionBy()))
    unit = (
        F.when(F.col("n") >= MIN_ROWS, F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))))
        .when(F.col("n_lang") >= MIN_ROWS, F.concat(F.lit("1"), F.to_json(F.struct("lang"))))
        .when(F.col("n_all") >= MIN_ROWS, F.lit("0"))
    )
    return g.select("lang", "source", unit.alias("unit"))


def distance(x: Column, center: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; ``inverse`` is the full matrix, row by row."""
    d = [F.get(x, F.lit(i)) - F.get(center, F.lit(i)) for i in range(P)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.get(inverse, F.lit(i * P + j)) * d[i] * d[j] * (1.0 if i == j else 2.0)
    return total


def cell_of(d2: Column) -> Column:
    """Fine cells of a distance, each about one percent wide."""
    return F.floor(F.log1p(F.greatest(d2, F.lit(0.0)) * 64.0) * 100.0).cast("int")


def sums(x: Column) -> list[Column]:
    first = [F.sum(F.get(x, F.lit(i))).alias(f"s{i}") for i in range(P)]
    second = [F.sum(F.get(x, F.lit(i)) * F.get(x, F.lit(j))).alias(f"q{i}_{j}") for i, j in PAIRS]
    return [F.count("*").alias("n"), *first, *second]


SUM_NAMES = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}_{j}" for i, j in PAIRS]]
ESTIMATE = "unit string, start int, center array<double>, inverse array<double>, logdet double"


def estimate(rows: pd.DataFrame, factor: float) -> pd.DataFrame:
    """Centre and inverse scatter from sums; one row per unit and start."""
    out = []
    for r in rows.itertuples(index=False):
        r = r._asdict()
        n = r["n"]
        center = np.array([r[f"s{i}"] for i in range(P)]) / n
        cov = np.empty((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / n - center[i] * center[j]
        out.append((r["unit"], r["start"], *settled(center, cov * factor)))
    return pd.DataFrame(out, columns=["unit", "start", "center", "inverse", "logdet"])


def settled(center: np.ndarray, cov: np.ndarray):
    # Variances reach their floor; a little more keeps the matrix regular.
    cov = cov + np.diag(np.maximum(LEAST**2 - np.diag(cov), 0.0) + 0.01 * LEAST**2)
    return center.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])


def estimated(per_unit: DataFrame, factor: float) -> DataFrame:
    def run(frames):
        for f in frames:
            yield estimate(f, factor)

    return stored(per_unit.select("unit", "start", *SUM_NAMES).mapInPandas(run, ESTIMATE), "mcd-estimate")


def starts(points: DataFrame) -> DataFrame:
    """Two robust starts per unit: medians with quartile scales, and with the scatter of signs."""
    bins = points.select("unit", F.posexplode("x").alias("j", "v")).groupBy(
        "unit", "j", F.floor(F.col("v") * 500).cast("long").alias("bin")
    )
    bins = bins.agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("unit", "j")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    value = (F.col("bin") + 0.5) / 500
    quantile = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, value))
    spread = bins.groupBy("unit", "j").agg(
        quantile(0.5).alias("middle"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("scale")
    )
    least = F.array(*[F.lit(float(v)) for v in LEAST])
    per_unit = spread.groupBy("unit").agg(
        F.array_sort(F.collect_list(F.struct("j", "middle", "scale"))).alias("a")  # one entry per statistic
    )
    per_unit = per_unit.select(
        "unit",
        F.transform("a", lambda s: s["middle"]).alias("center"),
        F.transform("a", lambda s: F.greatest(s["scale"], F.get(least, s["j"]))).alias("scale"),
    )
    per_unit = stored(per_unit, "mcd-start")
    inverse = F.flatten(
        F.transform("scale", lambda s, i: F.transform("scale", lambda t, j: F.when(i == j, 1 / (s * t)).otherwise(0.0)))
    )
    plain = per_unit.select(
        "unit", F.lit(0).alias("start"), "center", inverse.alias("inverse"), F.lit(0.0).alias("logdet")
    )
    u = F.zip_with(
        F.zip_with("x", "center", lambda a, b: a - b), "scale", lambda d, s: d / s
    )
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, v: a + v * v))
    signs = points.join(per_unit, "unit").select("unit", u.alias("u")).withColumn("norm", norm)
    signs = signs.where("norm > 0").select("unit", F.transform("u", lambda v: v / F.col("norm")).alias("u"))
    signs = signs.groupBy("unit").agg(*sums(F.col("u"))).join(per_unit, "unit")

    def run(frames):
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                shape = np.empty((P, P))
                for i, j in PAIRS:
                    shape[i, j] = shape[j, i] = r[f"q{i}_{j}"] / r["n"] * P
                scale = np.asarray(r["scale"])
                out.append((r["unit"], 1, *settled(np.asarray(r["center"]), shape * np.outer(scale, scale))))
            yield pd.DataFrame(out, columns=["unit", "start", "center", "inverse", "logdet"])

    return stored(plain.unionByName(signs.mapInPandas(run, ESTIMATE)), "mcd-start")


def concentrate(points: DataFrame, now: DataFrame) -> DataFrame:
    """One step: estimates from the nearest rows of each unit."""
    cells = (
        points.join(now, "unit")
        .withColumn("cell", cell_of(distance(F.col("x"), F.col("center"), F.col("inverse"))))
        .groupBy("unit", "start", "cell")
        .agg(*sums(F.col("x")))
    )
    group = W.Window.partitionBy("unit", "start")
    cells = cells.withColumn("before", F.sum("n").over(group.orderBy("cell")) - F.col("n"))
    cells = cells.withColumn("wanted", F.ceil(F.sum("n").over(group) * KEEP))
    inner = cells.where("before < wanted").groupBy("unit", "start")
    return estimated(inner.agg(*[F.sum(c).alias(c) for c in SUM_NAMES]), consistency(KEEP))


def fit(rows: DataFrame, lang: str, source: str, statistics: str) -> DataFrame:
    """``lang, source, center, inverse`` from all rows that passed the base rules."""
    unit_of = stored(units(rows, lang, source), "mcd-units")
    points = rows.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(statistics).alias("x"))
    points = points.join(
        unit_of.where("unit IS NOT NULL"),
        F.col("_lang").eqNullSafe(F.col("lang")) & F.col("_source").eqNullSafe(F.col("source")),
    )
    points = stored(points.select("unit", "x"), "mcd-points")
    now = starts(points)
    for _ in range(ROUNDS):
        now = concentrate(points, now)
    best = now.groupBy("unit").agg(F.min_by(F.struct("start", "center", "inverse"), "logdet").alias("b"))
    best = stored(best.select("unit", "b.*"), "mcd-best")
    within = solve(lambda x: chi2_cdf(x, P), WEIGHT_AT, 0.0, 500.0)
    near = points.join(best, "unit").where(
        distance(F.col("x"), F.col("center"), F.col("inverse")) <= within
    )
    final = estimated(near.groupBy("unit", "start").agg(*sums(F.col("x"))), consistency(WEIGHT_AT))
    return stored(unit_of.join(final.drop("start", "logdet"), "unit", "left").drop("unit"), "mcd-final")


def _judged(rows: DataFrame, model: DataFrame, lang: str, source: str, statistics: str, failed: str, out: str):
    names = dict(zip(model.columns, fresh(rows, *[f"mcd_{c}" for c in model.columns]), strict=True))
    m = model.withColumnsRenamed(names)
    on = F.col(lang).eqNullSafe(F.col(names["lang"])) & F.col(source).eqNullSafe(F.col(names["source"]))
    d2 = distance(F.col(statistics), F.col(names["center"]), F.col(names["inverse"]))
    verdict = ~F.col(failed) & F.coalesce(d2 <= CUT, F.lit(True))
    return rows.join(m, on, "left").select(*[F.col(f"`{c}`") for c in rows.columns], verdict.alias(out))


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail; null languages and sources are groups of their
    own; repeated rows are judged alike; an empty table gives no rows.  Further columns are left
    out, so their names cannot clash.
    """
    rows = with_counts(docs.select("doc_id", "lang", "source", "text"), "text", COUNTS, "x", drop=True)
    rows = rows.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = stored(rows, "mcd-rows")
    model = fit(rows.where("NOT base_failed"), "lang", "source", "x")
    return _judged(rows, model, "lang", "source", "x", "base_failed", "kept").select(
        "doc_id", *COUNTS, "base_failed", "kept"
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    narrow = with_counts(docs.select("lang", "source", "text"), "text", COUNTS, "x", drop=True)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    model = fit(stored(narrow.where(~failed).drop(*COUNTS), "mcd-rows"), "lang", "source", "x")
    *counts, x, bad, kept = fresh(docs, *COUNTS, "mcd_x", "mcd_failed", "mcd_kept")
    rows = with_counts(docs, "text", counts, x)
    rows = rows.withColumn(bad, base_failed(F.col(counts[0]), F.col(counts[4])))
    return _judged(rows, model, "lang", "source", x, bad, kept).where(F.col(kept)).select(*docs.columns)
