"""Text classifiers over documents with a quality label."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.functions.text import word_tokens
from uttermark.operators import classify, splits
from uttermark.plans.evaluation import rounded
from uttermark.plans.registry import query
from uttermark.plans.sampling import rank_sql
from uttermark.plans.text import DOC_WORDS
from uttermark.session import materialise

RATIOS = [0.0, 0.1, 0.5, 1.0]


def classes(t):
    return t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("class"))


def with_tokens(t, ids):
    docs = t.wide("documents", "doc_id", "text")
    return ids.join(docs, "doc_id").withColumn("tokens", word_tokens(F.col("text")))


def experiment(t):
    """Real = every third document, of which a fifth is the shared test set.

    The splits rank ids only; the texts are joined once, after all choices are made.
    """
    ids = classes(t)
    part = splits.holdout(ids.where("doc_id % 3 = 0"), ["class"], ["doc_id"])
    part = materialise(part)
    train = part.where("split = 'train'").drop("split")
    sweep = splits.ratio_sweep(train, ids.where("doc_id % 3 > 0"), RATIOS, ["class"], ["doc_id"])
    sweep = materialise(sweep.drop("origin"))
    return with_tokens(t, sweep), with_tokens(t, part.where("split = 'test'").drop("split"))


def nb_sql(train):
    """Naive Bayes over rows ``tr(cell, doc_id, class, k)`` and ``te(doc_id, class, k)``."""
    return f"""{train},
w AS (SELECT cell, class, tok, count(*) AS c FROM (SELECT cell, class, unnest(k) AS tok FROM tr) GROUP BY 1, 2, 3),
v AS (SELECT cell, count(DISTINCT tok) AS v FROM w GROUP BY 1), ms AS (SELECT cell, class, sum(c) AS t FROM w GROUP BY 1, 2),
dc AS (SELECT cell, class, count(*) AS n FROM tr GROUP BY 1, 2), tt AS (SELECT cell, sum(n) AS n FROM dc GROUP BY 1),
pr AS (SELECT dc.cell, dc.class, ln(dc.n / tt.n) AS prior, ln(coalesce(t, 0) + coalesce(v, 0)) AS den FROM dc JOIN tt USING (cell) LEFT JOIN ms USING (cell, class) LEFT JOIN v USING (cell)),
bag AS (SELECT doc_id, tok, count(*) AS q FROM (SELECT doc_id, unnest(k) AS tok FROM te) GROUP BY 1, 2),
kn AS (SELECT doc_id, cell, sum(q) AS nk FROM bag JOIN (SELECT DISTINCT cell, tok FROM w) x USING (tok) GROUP BY 1, 2),
ht AS (SELECT doc_id, cell, class, sum(q * ln(c + 1)) AS s FROM bag JOIN w USING (tok) GROUP BY 1, 2, 3),
sc AS (SELECT te.doc_id, te.class AS gold, pr.cell, pr.class, round(prior + coalesce(s, 0) - coalesce(nk, 0) * den, 6) AS score
  FROM te CROSS JOIN pr LEFT JOIN kn ON kn.doc_id = te.doc_id AND kn.cell = pr.cell LEFT JOIN ht ON ht.doc_id = te.doc_id AND ht.cell = pr.cell AND ht.class = pr.class),
pd AS (SELECT cell, doc_id, gold, class AS pred FROM (SELECT *, row_number() OVER (PARTITION BY cell, doc_id ORDER BY score DESC, class) AS r FROM sc) WHERE r = 1)"""


LABELLED_SQL = f"""lab AS (SELECT l.doc_id, text, 'q' || quality AS class, {DOC_WORDS} AS k FROM labels l JOIN documents d USING (doc_id))"""


def _sweep_sql():
    arms = ["SELECT 'real_only' AS cell, doc_id, class, k FROM r"]
    for f in RATIOS:
        arms.append(f"SELECT '{f:.2f}', doc_id, class, k FROM lab WHERE doc_id % 3 > 0")
        if f > 0:
            cond = "TRUE" if f >= 1 else f"rn <= greatest(1, round_even(n * {f}::DOUBLE, 0))"
            arms.append(f"SELECT '{f:.2f}', doc_id, class, k FROM r WHERE {cond}")
    return f"""{LABELLED_SQL}, h AS ({rank_sql("lab", "class", "doc_id", "holdout-42", "doc_id % 3 = 0")}),
te AS (SELECT doc_id, class, k FROM h WHERE rn > floor(n * 0.8::DOUBLE)),
rt AS (SELECT doc_id, class, k FROM h WHERE rn <= floor(n * 0.8::DOUBLE)), r AS ({rank_sql("rt", "class", "doc_id", 42)}),
tr AS ({" UNION ALL ".join(arms)})"""


@query(
    "n1_intent_sweep",
    f"""WITH {nb_sql(_sweep_sql())}
SELECT cell, count(*) AS n_test, count(*) FILTER (WHERE pred = gold) AS n_correct, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pd GROUP BY 1""",
)
def n1(t):
    train, test = experiment(t)
    return rounded(classify.intent_sweep(train, test, "doc_id"), "accuracy")


@query("n1_intent_sweep_logreg")
def n1_logreg(t):
    train, test = experiment(t)
    return rounded(classify.intent_sweep_logreg(train, test, ["real_only", *[f"{r:.2f}" for r in RATIOS]]), "accuracy")


@query(
    "n2_partition_baseline",
    f"""WITH {LABELLED_SQL}, {nb_sql("tr AS (SELECT 'all' AS cell, * EXCLUDE (text) FROM lab WHERE doc_id % 2 = 0), te AS (SELECT doc_id, class, k FROM lab WHERE doc_id % 2 = 1)")},
ov AS (SELECT doc_id, CASE WHEN lower(trim(text)) IN (SELECT lower(trim(text)) FROM lab WHERE doc_id % 2 = 0) THEN 'overlap' ELSE 'novel' END AS part FROM lab WHERE doc_id % 2 = 1)
SELECT part, CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS tp, count(*) AS n, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, grouping(part) = 1 AS is_total
FROM pd JOIN ov USING (doc_id) GROUP BY ROLLUP(part)""",
)
def n2(t):
    d = with_tokens(t, classes(t))
    out = classify.partition_baseline(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id", "text")
    return rounded(out, "accuracy")
