"""Scores of predictions made by fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.operators import match, metrics
from uttermark.plans.joins import BAG_SQL, SLOT_PAIRS_SQL, slot_pairs
from uttermark.plans.registry import TAGGED_SQL, query, spans_sql

PRED_SQL = """pred AS (SELECT l.doc_id, lang, source, 'q' || quality AS gold,
  CASE WHEN n_chars % 7 = 0 THEN NULL WHEN n_chars % 3 = 0 THEN 'q0' ELSE 'q1' END AS pred,
  doc_id % 5 AS fold FROM labels l JOIN documents d USING (doc_id))"""


def predictions(t):
    """Gold = quality label; prediction = a rule on the length, sometimes none."""
    n = F.col("n_chars")
    p = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 3 == 0, "q0").otherwise("q1")
    d = t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return d.select(
        "doc_id", "lang", "source",
        F.concat(F.lit("q"), F.col("quality")).alias("gold"),
        p.alias("pred"),
        (F.col("doc_id") % 5).alias("fold"),
    )


def rounded(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query(
    "e9_accuracy",
    f"""WITH {PRED_SQL}
SELECT lang, CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(*) AS n,
  round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, grouping(lang) = 1 AS is_total FROM pred GROUP BY ROLLUP(lang)""",
)
def e9(t):
    same = metrics.norm_label(F.col("gold")).eqNullSafe(metrics.norm_label(F.col("pred")))
    return rounded(metrics.accuracy(predictions(t).withColumn("ok", same), "lang", "ok"), "accuracy")


@query(
    "e10_confusion",
    f"""WITH {PRED_SQL} SELECT gold, coalesce(pred, 'None') AS pred, count(*) AS n FROM pred
WHERE gold <> coalesce(pred, 'None') GROUP BY 1, 2""",
)
def e10(t):
    return metrics.confusion(predictions(t), "gold", "pred")


PRF_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(
    "e11_prf_by_class",
    f"""WITH {PRED_SQL}, c AS (SELECT 'q0' AS class UNION ALL SELECT 'q1'),
x AS (SELECT class, CAST(count(*) FILTER (WHERE gold = class AND pred = class) AS BIGINT) AS tp,
  count(*) FILTER (WHERE gold <> class AND pred = class) AS fp,
  count(*) FILTER (WHERE gold = class AND (pred IS NULL OR pred <> class)) AS fn FROM pred, c GROUP BY class),
y AS (SELECT *, false AS is_total FROM x UNION ALL SELECT NULL, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), true FROM x)
SELECT class, is_total, tp, fp, fn, {PRF_SQL} FROM y""",
)
def e11(t):
    d = metrics.prf_by_class(predictions(t), "gold", "pred")
    return rounded(d, "precision", "recall", "f1")


SPAN_SQL = f"""{TAGGED_SQL}, {spans_sql("gold", "gs")}, {spans_sql("pred", "ps")},
j AS (SELECT coalesce(g.label, p.label) AS label, g.s IS NOT NULL AS ing, p.s IS NOT NULL AS inp
  FROM gs g FULL JOIN ps p ON g.utt_id = p.utt_id AND g.s = p.s AND g.e = p.e AND g.label = p.label),
x AS (SELECT label, count(*) FILTER (WHERE ing AND inp) AS tp, count(*) FILTER (WHERE inp AND NOT ing) AS fp,
  count(*) FILTER (WHERE ing AND NOT inp) AS fn, grouping(label) = 1 AS is_total FROM j GROUP BY ROLLUP(label))"""


@query("e12_span_f1", f"WITH {SPAN_SQL} SELECT label, is_total, tp, fp, fn, tp + fn AS support, {PRF_SQL} FROM x")
def e12(t):
    return rounded(metrics.span_f1(t.tagged, "gold", "pred"), "precision", "recall", "f1")


FOLD_ROWS_SQL = f"""{PRED_SQL}, fm AS (
  SELECT CASE WHEN lang = 'en' THEN 'base' ELSE lang END AS experiment, fold,
    avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN pred IS NULL THEN 1.0 ELSE 0.0 END) AS refused, count(*) AS n
  FROM pred GROUP BY 1, 2),
m AS (SELECT experiment, 'accuracy' AS metric, accuracy AS value FROM fm UNION ALL SELECT experiment, 'refused', refused FROM fm),
a AS (SELECT experiment, sum(n) AS n_added FROM fm GROUP BY 1)"""


def fold_metrics(t):
    name = F.when(F.col("lang") == "en", "base").otherwise(F.col("lang"))
    ok = F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))
    fm = predictions(t).groupBy(name.alias("experiment"), "fold").agg(
        F.avg(ok).alias("accuracy"),
        F.avg(F.col("pred").isNull().cast("double")).alias("refused"),
        F.count(F.lit(1)).alias("n"),
    )
    long = fm.selectExpr(
        "experiment", "fold", "stack(2, 'accuracy', accuracy, 'refused', refused) AS (metric, value)"
    )
    return long, fm.groupBy("experiment").agg(F.sum("n").alias("n_added"))


@query(
    "e13_fold_summary",
    f"""WITH {FOLD_ROWS_SQL}, s AS (SELECT experiment, metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n_folds FROM m GROUP BY 1, 2)
SELECT s.experiment, s.metric, round(s.mean, 6) AS mean, round(s.std, 6) AS std, s.n_folds,
  round((s.mean - b.mean) * 100, 6) AS delta_pp, CAST(n_added AS BIGINT) AS n_added, round((s.mean - b.mean) * 100 / n_added, 6) AS delta_pp_per_row
FROM s JOIN s b ON b.metric = s.metric AND b.experiment = 'base' JOIN a ON a.experiment = s.experiment""",
)
def e13(t):
    long, added = fold_metrics(t)
    d = metrics.fold_summary(long, "base", added)
    return rounded(d, "mean", "std", "delta_pp", "delta_pp_per_row")


@query(
    "e14_compare_sides",
    f"""WITH {PRED_SQL}, x AS (SELECT source, 'accuracy' AS metric, CASE WHEN lang = 'en' THEN 'real' ELSE 'synthetic' END AS side,
  round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 4) AS value FROM pred GROUP BY 1, 2, 3),
w AS (SELECT source, metric, max(value) FILTER (WHERE side = 'real') AS real, max(value) FILTER (WHERE side = 'synthetic') AS synthetic FROM x GROUP BY 1, 2)
SELECT source, metric, real, synthetic, round((real - synthetic) * 100, 6) AS delta_pp,
  CASE WHEN real IS NULL OR synthetic IS NULL THEN 'n/a' ELSE printf('%+.2f', round((real - synthetic) * 100, 2)) END AS shown FROM w""",
)
def e14(t):
    side = F.when(F.col("lang") == "en", "real").otherwise("synthetic")
    ok = F.coalesce((F.col("pred") == F.col("gold")).cast("double"), F.lit(0.0))
    m = predictions(t).groupBy("source", F.lit("accuracy").alias("metric"), side.alias("side")).agg(
        F.round(F.avg(ok), 4).alias("value")
    )
    return rounded(metrics.compare_sides(m, ["source", "metric"]), "delta_pp")


@query(
    "e31_slot_recall",
    f"""WITH {SLOT_PAIRS_SQL}, {BAG_SQL}, r AS (SELECT utt_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM bag GROUP BY 1)
SELECT gold_intent, round(CASE WHEN sum(tp + fn) > 0 THEN sum(tp) / sum(tp + fn) ELSE 0 END, 6) AS slot_recall,
  count(*) FILTER (WHERE fn > 0 OR fp > 0) AS n_rows_with_error FROM r JOIN intents USING (utt_id) GROUP BY 1""",
)
def e31(t):
    bags = match.bag_match(slot_pairs(t), ["utt_id", "gold_intent"], "gold_slots", "pred_slots")
    return rounded(metrics.slot_recall(bags, "gold_intent"), "slot_recall")


@query(
    "e31_slot_f1_intent_gated",
    f"""WITH {SLOT_PAIRS_SQL}, ok AS (SELECT utt_id FROM intents WHERE pred_intent = gold_intent),
pk AS (SELECT * FROM pv WHERE utt_id IN (SELECT utt_id FROM ok)),
b AS (SELECT slot_name, sum(least(coalesce(g, 0), coalesce(p, 0))) AS tp, sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0)) AS fp,
  sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0)) AS fn FROM gv FULL JOIN pk USING (utt_id, slot_name, v) GROUP BY 1)
SELECT slot_name, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, {PRF_SQL} FROM b""",
)
def e31_gated(t):
    """Slot scores where a wrong intent makes every gold slot of the row a miss."""
    bags = match.bag_match(slot_pairs(t), ["utt_id"], "gold_slots", "pred_slots", require_intent=True)
    sums = bags.groupBy("slot_name").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return rounded(metrics.with_prf(sums), "precision", "recall", "f1")


@query(
    "e32_best_epoch",
    f"""WITH {FOLD_ROWS_SQL} SELECT experiment, round(max(accuracy), 6) AS best, min(fold) FILTER (WHERE accuracy = mx) AS epoch, true AS selected_on_test
FROM (SELECT *, max(accuracy) OVER (PARTITION BY experiment) AS mx FROM fm) GROUP BY 1""",
)
def e32(t):
    long, _ = fold_metrics(t)
    d = metrics.best_epoch(long.where("metric = 'accuracy'"), ["experiment"], "value", "fold")
    return rounded(d, "best")
