"""What explains the errors: group spread, variance share, within-group contrast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.util import ratio
from uttermark.operators.order import exact_percentiles
from uttermark.session import sized


def group_error(df: DataFrame, group: str, correct: str) -> DataFrame:
    return df.groupBy(group).agg(
        (1.0 - F.avg(F.col(correct).cast("int"))).alias("error"), F.count(F.lit(1)).alias("n")
    )


def group_error_spread(df: DataFrame, group: str, correct: str) -> DataFrame:
    """Min, max, range and population deviation of the groups' error rates."""
    return group_error(df, group, correct).agg(
        F.min("error").alias("min_error"),
        F.max("error").alias("max_error"),
        (F.max("error") - F.min("error")).alias("range"),
        F.stddev_pop("error").alias("std"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def eta_squared(df: DataFrame, group: str, correct: str) -> DataFrame:
    """Share of the variance of ``correct`` that lies between the groups; 0 if none."""
    x = F.col(correct).cast("double")
    per = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q")
    )
    whole = per.agg(
        F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"),
        F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("_b"),
    )
    mean_part = F.col("_s") * F.col("_s") / F.col("_n")
    total = F.col("_q") - mean_part
    eta = F.when(total > 0, (F.col("_b") - mean_part) / F.when(total > 0, total)).otherwise(0.0)
    return whole.select(eta.alias("eta_squared"))


def within_group_effect(
    df: DataFrame, group: str, x: str, correct: str, min_rows: int = 8
) -> DataFrame:
    """Per group of at least ``min_rows``: error at or below its own median of ``x`` against
    error above it; averaged over the groups that have both, in percentage points."""
    med = exact_percentiles(df, [group], x, {"_med": 50})
    low = F.col(x) <= F.col("_med")
    err = 1.0 - F.col(correct).cast("double")
    per = df.join(med, group).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.when(low, err)).alias("_lo"),
        F.avg(F.when(~low, err)).alias("_hi"),
    )
    both = per.where((F.col("_n") >= min_rows) & F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    return both.agg(
        F.avg("_lo").alias("low_error"),
        F.avg("_hi").alias("high_error"),
        F.coalesce((F.avg("_lo") - F.avg("_hi")) * 100.0, F.lit(0.0)).alias("effect_pp"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def quantile_bucket(
    df: DataFrame, x: str, q: tuple[float, ...] = (25, 50, 75), out: str = "bucket"
) -> DataFrame:
    """Bucket 1..len(q)+1 by linear percentiles of the whole table, upper bound inclusive."""
    cuts = exact_percentiles(df, [], x, {f"_q{i}": p for i, p in enumerate(q)})
    both = df.crossJoin(cuts)  # cuts is one row
    bucket = F.lit(len(q) + 1)
    for i in reversed(range(len(q))):
        bucket = F.when(F.col(x) <= F.col(f"_q{i}"), i + 1).otherwise(bucket)
    return both.withColumn(out, bucket).drop(*[f"_q{i}" for i in range(len(q))])


def metric_profile(df: DataFrame, metrics: list[str], side: str) -> DataFrame:
    """Median, p10, p90 and n of many metrics for two corpora side by side; ``delta`` is
    the synthetic median less the real one."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    long = df.selectExpr(f"{side} AS side", f"stack({len(metrics)}, {pairs}) AS (metric, x)")
    n = long.groupBy("metric", "side").agg(F.count("x").alias("n"))
    p = exact_percentiles(long, ["metric", "side"], "x", {"p10": 10, "median": 50, "p90": 90})
    both = p.join(n, ["metric", "side"])
    wide = both.groupBy("metric").pivot("side", ["real", "synthetic"]).agg(
        *[F.max(c).alias(c) for c in ("median", "p10", "p90", "n")]
    )
    return wide.withColumn("delta", F.col("synthetic_median") - F.col("real_median"))


def time_features(samples: DataFrame, win_ms: int = 100) -> DataFrame:
    """Time-domain features of clips in long form ``(clip_id, sr, pos, amp)``.

    RMS, peak, crest factor; noise floor and speech level as 10th and 90th percentile of
    the RMS over full windows that do not overlap, their ratio in dB.  A clip of fewer
    than two windows uses its overall RMS for both.
    """
    win = F.floor(F.col("sr") * (win_ms / 1000.0))
    part = samples.withColumn("_win", win).groupBy(
        "clip_id", F.expr("CASE WHEN _win > 0 THEN pos div _win END").alias("_w")
    )
    # One row per window, stored: everything else follows from it, the samples are read once.
    parts = sized(
        part.agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_win").alias("_win"),
            F.max("sr").alias("sr"),
            F.count("amp").alias("_amps"),
            F.sum(F.col("amp") * F.col("amp")).alias("_power"),
            F.max(F.abs("amp")).alias("peak"),
        ),
        "windows",
    )
    full = F.col("_w").isNotNull() & (F.col("_n") == F.col("_win"))

    def rms(power, n):
        return F.sqrt(power / n + 1e-12)

    clip = parts.groupBy("clip_id").agg(
        F.sum("_n").alias("n_samples"),
        F.max("sr").alias("sr"),
        rms(F.sum("_power"), F.sum("_amps")).alias("rms"),
        F.max("peak").alias("peak"),
        F.count_if(full).alias("_windows"),
    )
    w = parts.where(full).select("clip_id", rms(F.col("_power"), F.col("_amps")).alias("_rms"))
    levels = exact_percentiles(w, ["clip_id"], "_rms", {"_p10": 10, "_p90": 90})
    out = clip.join(levels, "clip_id", "left")
    enough = F.col("_windows") >= 2
    noise = F.when(enough, F.col("_p10")).otherwise(F.col("rms"))
    speech = F.when(enough, F.col("_p90")).otherwise(F.col("rms"))

    def db(a, b):
        return 20.0 * F.log10((a + 1e-9) / (b + 1e-9))

    return out.select(
        "clip_id",
        "n_samples",
        ratio(F.col("n_samples"), F.col("sr")).alias("duration"),
        "rms",
        "peak",
        db(F.col("peak"), F.col("rms")).alias("crest_db"),
        noise.alias("noise_floor_rms"),
        speech.alias("speech_rms"),
        db(speech, noise).alias("snr_db"),
    )
