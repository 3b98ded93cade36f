"""Error diagnostics over events (speaker = user, wrong = 'error', quality = value)."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.operators import diagnose, similarity
from uttermark.operators.order import running
from uttermark.plans.evaluation import rounded
from uttermark.plans.registry import query


def outcomes(t):
    return t.events.select(
        "event_id", "user_id", "value", (F.col("event_type") != "error").cast("int").alias("correct")
    )


OUT_SQL = "o AS (SELECT event_id, user_id, value, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS correct FROM events)"


@query(
    "e15_group_error_spread",
    f"""WITH {OUT_SQL}, g AS (SELECT user_id, 1 - avg(correct) AS e FROM o GROUP BY 1)
SELECT round(min(e), 6) AS min_error, round(max(e), 6) AS max_error, round(max(e) - min(e), 6) AS range,
  round(stddev_pop(e), 6) AS std, count(*) AS n_groups FROM g""",
)
def e15(t):
    d = diagnose.group_error_spread(outcomes(t), "user_id", "correct")
    return rounded(d, "min_error", "max_error", "range", "std")


@query(
    "e16_eta_squared",
    f"""WITH {OUT_SQL}, m AS (SELECT avg(correct) AS gm FROM o),
g AS (SELECT user_id, count(*) AS n, avg(correct) AS am FROM o GROUP BY 1)
SELECT round((SELECT sum(n * (am - gm) * (am - gm)) FROM g, m) / (SELECT sum((correct - gm) * (correct - gm)) FROM o, m), 6) AS eta_squared""",
)
def e16(t):
    return rounded(diagnose.eta_squared(outcomes(t), "user_id", "correct"), "eta_squared")


@query(
    "e17_within_group_effect",
    f"""WITH {OUT_SQL}, m AS (SELECT user_id, median(value) AS med FROM o GROUP BY 1),
g AS (SELECT user_id, count(*) AS n, avg(1 - correct) FILTER (WHERE value <= med) AS lo, avg(1 - correct) FILTER (WHERE value > med) AS hi
  FROM o JOIN m USING (user_id) GROUP BY 1)
SELECT round(avg(lo), 6) AS low_error, round(avg(hi), 6) AS high_error, round((avg(lo) - avg(hi)) * 100, 6) AS effect_pp, count(*) AS n_groups
FROM g WHERE n >= 8 AND lo IS NOT NULL AND hi IS NOT NULL""",
)
def e17(t):
    d = diagnose.within_group_effect(outcomes(t), "user_id", "value", "correct")
    return rounded(d, "low_error", "high_error", "effect_pp")


@query(
    "f5_quantile_bucket",
    f"""WITH {OUT_SQL}, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM o)
SELECT CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS bucket, count(*) AS n, round(1 - avg(correct), 6) AS error
FROM o, q GROUP BY 1""",
)
def f5(t):
    d = diagnose.quantile_bucket(outcomes(t), "value")
    return rounded(diagnose.group_error(d, "bucket", "correct"), "error")


def _profile_sql():
    parts = []
    for metric, expr in (("n_chars", "n_chars"), ("n_lines", "len(string_split(text, chr(10)))")):
        parts.append(f"SELECT '{metric}' AS metric, side, CAST({expr} AS DOUBLE) AS x FROM d")
    sides = ", ".join(
        f"round(quantile_cont(x, 0.5) FILTER (WHERE side = '{s}'), 6) AS {s}_median, round(quantile_cont(x, 0.1) FILTER (WHERE side = '{s}'), 6) AS {s}_p10, "
        f"round(quantile_cont(x, 0.9) FILTER (WHERE side = '{s}'), 6) AS {s}_p90, count(*) FILTER (WHERE side = '{s}') AS {s}_n"
        for s in ("real", "synthetic")
    )
    return f"""WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS side FROM documents),
l AS ({" UNION ALL ".join(parts)})
SELECT metric, {sides}, round(quantile_cont(x, 0.5) FILTER (WHERE side = 'synthetic') - quantile_cont(x, 0.5) FILTER (WHERE side = 'real'), 6) AS delta
FROM l GROUP BY metric"""


@query("e6_metric_profile", _profile_sql())
def e6(t):
    side = F.when(F.col("doc_id") % 2 == 0, "real").otherwise("synthetic").alias("side")
    d = t.documents.select(side, "n_chars", F.size(F.split("text", "\n")).alias("n_lines"))
    out = diagnose.metric_profile(d, ["n_chars", "n_lines"], "side")
    return rounded(out, *[c for c in out.columns if c != "metric" and not c.endswith("_n")])


@query(
    "e18_centroid_similarity",
    """WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS a, generate_subscripts(embedding, 1) AS d FROM embeddings),
s AS (SELECT label, d, sum(a) AS s, count(*) AS n FROM x GROUP BY 1, 2),
own AS (SELECT vec_id, label, sum(a * (s - a) / (n - 1)) / (sqrt(sum(a * a)) + 1e-9) / (sqrt(sum(((s - a) / (n - 1)) * ((s - a) / (n - 1)))) + 1e-9) AS self_cos,
  sum(a * s / n) / (sqrt(sum(a * a)) + 1e-9) / (sqrt(sum((s / n) * (s / n))) + 1e-9) AS own_cos FROM x JOIN s USING (label, d) GROUP BY 1, 2),
cr AS (SELECT vec_id, s.label AS other, sum(a * s / n) / (sqrt(sum(a * a)) + 1e-9) / (sqrt(sum((s / n) * (s / n))) + 1e-9) AS c
  FROM x JOIN s ON s.d = x.d AND s.label <> x.label GROUP BY 1, 2)
SELECT own.vec_id, own.label, round(self_cos, 6) AS self_cos, round(own_cos, 6) AS own_cos, round(avg(c), 6) AS cross_cos, round(own_cos - avg(c), 6) AS delta
FROM own JOIN cr ON cr.vec_id = own.vec_id GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY own.vec_id, own.label, self_cos, own_cos"),
)
def e18(t):
    d = similarity.centroid_similarity(t.embeddings, "vec_id", "label", "embedding")
    return rounded(d, "self_cos", "own_cos", "cross_cos", "delta")


def sample_frames(t, sr=40):
    """Events as samples: clip = user, position by time, amplitude = value rescaled."""
    e = t.events.select("user_id", "ts", "event_id", (F.col("value") / 500.0).alias("amp"))
    pos = running(
        e, ["user_id"], [F.col("ts"), F.col("event_id")], F.expr("unix_timestamp(ts) div 86400")
    )
    return pos.select(
        F.col("user_id").alias("clip_id"), F.lit(sr).alias("sr"), (F.col("rn") - 1).alias("pos"), "amp"
    )


@query(
    "e33_time_features",
    """WITH p AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value / 500.0 AS amp FROM events),
c AS (SELECT clip_id, count(*) AS n_samples, sqrt(avg(amp * amp) + 1e-12) AS rms, max(abs(amp)) AS peak FROM p GROUP BY 1),
w AS (SELECT clip_id, pos // 4 AS w, sqrt(avg(amp * amp) + 1e-12) AS r FROM p GROUP BY 1, 2 HAVING count(*) = 4),
l AS (SELECT clip_id, count(*) AS k, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.9) AS p90 FROM w GROUP BY 1),
f AS (SELECT c.*, CASE WHEN coalesce(k, 0) >= 2 THEN p10 ELSE rms END AS noise, CASE WHEN coalesce(k, 0) >= 2 THEN p90 ELSE rms END AS speech FROM c LEFT JOIN l USING (clip_id))
SELECT clip_id, n_samples, round(n_samples / 40.0, 6) AS duration, round(rms, 6) AS rms, round(peak, 6) AS peak,
  round(20 * log10((peak + 1e-9) / (rms + 1e-9)), 6) AS crest_db, round(noise, 6) AS noise_floor_rms, round(speech, 6) AS speech_rms,
  round(20 * log10((speech + 1e-9) / (noise + 1e-9)), 6) AS snr_db FROM f""",
)
def e33(t):
    d = diagnose.time_features(sample_frames(t))
    return rounded(d, *[c for c in d.columns if c not in ("clip_id", "n_samples")])
