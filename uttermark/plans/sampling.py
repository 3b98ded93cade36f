"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.operators import splits
from uttermark.operators.order import seeded_order
from uttermark.plans.registry import query
from uttermark.session import literal_table


def rank_sql(table, by, key, seed, where="TRUE"):
    part = f"PARTITION BY {by}" if by else ""
    h = f"md5('{seed}:' || {key})"
    return (
        f"SELECT *, row_number() OVER ({part} ORDER BY {h}, {key}) AS rn, count(*) OVER ({part}) AS n "
        f"FROM {table} WHERE {where}"
    )


@query(
    "g3_seeded_order",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents",
)
def g3(t):
    from uttermark.operators.order import ranked

    return ranked(t.documents.select("doc_id"), [], ["doc_id"], 42, "place")


@query("g3_seeded_shuffle", "SELECT doc_id, lang FROM documents")
def g3_sort(t):
    return seeded_order(t.documents.select("doc_id", "lang"), ["doc_id"])


def _group_split_sql(key, table, total, dev, test, exact=False):
    if exact:
        return f"""WITH k AS (SELECT DISTINCT {key} AS k FROM {table}), r AS ({rank_sql("k", "", "k", 42)}),
s AS (SELECT k, CASE WHEN n >= {total} AND rn > {total} THEN 'unused' WHEN rn <= CASE WHEN n >= {total} THEN {test} ELSE greatest(1, n * {test} // {total}) END THEN 'test'
  WHEN rn <= CASE WHEN n >= {total} THEN {test} + {dev} ELSE greatest(1, n * {test} // {total}) + greatest(1, n * {dev} // {total}) END THEN 'dev'
  ELSE 'train' END AS split FROM r)"""
    return f"""WITH k AS (SELECT DISTINCT {key} AS k FROM {table}), r AS ({rank_sql("k", "", "k", 42)}),
s AS (SELECT k, CASE WHEN rn <= greatest(1, n * {test} // {total}) THEN 'test'
  WHEN rn <= greatest(1, n * {test} // {total}) + greatest(1, n * {dev} // {total}) THEN 'dev'
  ELSE 'train' END AS split FROM r)"""


@query(
    "j1_group_split",
    _group_split_sql("conv_id", "conversations", 5871, 490, 893)
    + " SELECT c.conv_id, c.turn, s.split FROM conversations c JOIN s ON s.k = c.conv_id",
)
def j1(t):
    """The published sizes (fixed values) as ratios of the conversations there are."""
    d = splits.group_split(t.conversations, "conv_id", (4488, 490, 893))
    return d.select("conv_id", "turn", "split")


@query(
    "j1_group_split_cut",
    _group_split_sql("l_orderkey", "lineitem", 5871, 490, 893, exact=True)
    + " SELECT split, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups FROM lineitem l JOIN s ON s.k = l.l_orderkey GROUP BY 1",
)
def j1_cut(t):
    """More orders than the published sizes: the sizes are exact, the surplus is counted."""
    d = splits.group_split(
        t.lineitem.select("l_orderkey"), "l_orderkey", (4488, 490, 893), exact=True
    )
    per = d.groupBy("split", "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


LOW = [("de", "train", 30, "SRC_3"), ("de", "test", 15, "src_3"), ("fr", "train", 500, "src_1")]


@query(
    "j2_low_resource_cut",
    f"""WITH d AS (SELECT doc_id, lang, source AS intent, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents),
c(lang, split, target, excluded) AS (VALUES {", ".join(str(r) for r in LOW)}),
k AS (SELECT d.*, c.target FROM d LEFT JOIN c USING (lang, split) WHERE NOT coalesce(lower(d.intent) = lower(c.excluded), false)),
r AS ({rank_sql("k", "lang, split", "doc_id", 42)})
SELECT doc_id, lang, intent, split FROM r WHERE target IS NULL OR rn <= target""",
)
def j2(t):
    config = literal_table(t.spark, "lang string, split string, target int, excluded string", LOW)
    d = t.documents.select(
        "doc_id", "lang", F.col("source").alias("intent"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
    )
    return splits.low_resource_cut(d, config, ["doc_id"]).select("doc_id", "lang", "intent", "split")


def events(t):
    return t.events.select("event_id", "event_type", "user_id")


E_RANK = rank_sql("events", "event_type", "event_id", 42)


@query(
    "j3_stratified_split",
    f"WITH r AS ({E_RANK}) SELECT event_id, CASE WHEN rn <= floor(n * 0.885::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r",
)
def j3(t):
    d = splits.stratified_split(events(t), ["event_type"], ["event_id"])
    return d.select("event_id", "split")


@query(
    "j4_stratified_fraction",
    f"WITH r AS ({E_RANK}) SELECT event_id, event_type FROM r WHERE rn <= greatest(1, round_even(n * 0.05::DOUBLE, 0))",
)
def j4(t):
    d = splits.stratified_fraction(events(t), ["event_type"], ["event_id"], 0.05)
    return d.select("event_id", "event_type")


@query(
    "j5_stratified_kfold",
    f"WITH r AS ({E_RANK}) SELECT event_id, event_type, (rn - 1) % 5 AS fold FROM r",
)
def j5(t):
    d = splits.stratified_kfold(events(t), ["event_type"], ["event_id"])
    return d.select("event_id", "event_type", "fold")


@query(
    "j6_stratified_n",
    f"""WITH r AS ({rank_sql("documents", "source, lang", "doc_id", 42)})
SELECT doc_id, lang FROM r WHERE rn <= greatest(1, round_even(n / (SELECT count(*) FROM documents) * 300, 0))""",
)
def j6(t):
    d = t.documents.select("doc_id", "lang", "source")
    d = splits.stratified_n(d, ["source", "lang"], ["doc_id"], 300, floor=1)
    return d.select("doc_id", "lang")


@query(
    "j7_holdout",
    f"""WITH r AS ({rank_sql("documents", "lang", "doc_id", "holdout-42")})
SELECT doc_id, lang, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""",
)
def j7(t):
    d = splits.holdout(t.documents.select("doc_id", "lang"), ["lang"], ["doc_id"])
    return d.select("doc_id", "lang", "split")


@query(
    "j8_dev_holdout",
    f"""WITH r AS ({rank_sql("documents", "", "doc_id", 42)})
SELECT doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'dev' ELSE 'train' END AS split FROM r""",
)
def j8(t):
    return splits.dev_holdout(t.documents.select("doc_id"), ["doc_id"]).select("doc_id", "split")


RATIOS = [0.0, 0.05, 0.1, 0.25, 0.5, 1.0]


def sweep(t):
    d = t.documents.select("doc_id", "lang")
    real, synth = d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0")
    return splits.ratio_sweep(real, synth, RATIOS, ["lang"], ["doc_id"])


def _sweep_sql():
    arms = ["SELECT 'real_only' AS cell, 'real' AS origin FROM r"]
    for f in RATIOS:
        arms.append(f"SELECT '{f:.2f}', 'synthetic' FROM documents WHERE doc_id % 3 > 0")
        if f >= 1:
            arms.append(f"SELECT '{f:.2f}', 'real' FROM r")
        elif f > 0:
            arms.append(f"SELECT '{f:.2f}', 'real' FROM r WHERE rn <= greatest(1, round_even(n * {f}::DOUBLE, 0))")
    return f"""WITH r AS ({rank_sql("documents", "lang", "doc_id", 42, "doc_id % 3 = 0")}), c AS ({" UNION ALL ".join(arms)})
SELECT cell, count(*) AS n_train, count(*) FILTER (WHERE origin = 'real') AS n_real, count(*) FILTER (WHERE origin = 'synthetic') AS n_synthetic FROM c GROUP BY 1"""


@query("j9_ratio_sweep", _sweep_sql())
def j9(t):
    return splits.cell_sizes(sweep(t))


@query(
    "j10_sample_n",
    f"WITH r AS ({rank_sql('events', '', 'event_id', 42)}) SELECT event_id FROM r WHERE rn <= 500",
)
def j10(t):
    return splits.sample_n(t.events.select("event_id"), ["event_id"], 500)


@query(
    "j11_assert_no_leak",
    f"""WITH r AS ({rank_sql("documents", "lang", "doc_id", "holdout-42")}),
s AS (SELECT doc_id, md5(text) AS k, rn <= floor(n * 0.8::DOUBLE) AS train FROM r)
SELECT count(*) AS n_refs, count(*) FILTER (WHERE k IN (SELECT k FROM s WHERE NOT train)) AS n_leaked FROM s WHERE train""",
)
def j11(t):
    """By id the split has no leak; by text it has, as some documents are copies."""
    d = t.documents.select("doc_id", "lang", F.md5("text").alias("k"))
    s = splits.holdout(d, ["lang"], ["doc_id"])
    refs = s.where("split = 'train'")
    return splits.assert_no_leak(refs, s.where("split = 'test'"), "k")


@query(
    "j12_fold_cells",
    f"""WITH r AS ({E_RANK}), c AS (SELECT unnest(range(0, 5)) AS cell)
SELECT cell, CASE WHEN (rn - 1) % 5 = cell THEN 'test' ELSE 'train' END AS role, event_type, count(*) AS n FROM r, c GROUP BY 1, 2, 3""",
)
def j12(t):
    d = splits.stratified_kfold(events(t), ["event_type"], ["event_id"])
    d = d.groupBy("fold", "event_type").agg(F.count(F.lit(1)).alias("c"))
    out = splits.fold_cells(d, 5)
    return out.groupBy(F.col("cell").cast("bigint").alias("cell"), "role", "event_type").agg(
        F.sum("c").alias("n")
    )
