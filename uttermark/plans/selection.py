"""Reference selection over line items (speaker = supplier, intent = line number)."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.operators import selection
from uttermark.operators.order import first_seen
from uttermark.plans.registry import query

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def clips(t):
    return t.lineitem.select(
        F.col("l_suppkey").alias("speaker"),
        F.col("l_linenumber").alias("intent"),
        (F.col("l_quantity") / 4).alias("dur"),
        *ORDER,
    )


CLIPS_SQL = """clips AS (SELECT l_suppkey AS speaker, l_linenumber AS intent, l_quantity / 4 AS dur, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem)"""


@query(
    "f2_pick_closest",
    f"""WITH {CLIPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY abs(dur - 6), pos) AS r FROM clips WHERE dur <= 12)
SELECT speaker, intent, dur, l_orderkey FROM r WHERE r = 1""",
)
def f2(t):
    d = selection.pick_closest(clips(t), "speaker", "dur", ORDER)
    return d.select("speaker", "intent", "dur", "l_orderkey")


@query(
    "f3_pick_diverse",
    f"""WITH {CLIPS_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY speaker, intent ORDER BY dur DESC, pos) AS rc FROM clips WHERE dur BETWEEN 5 AND 12),
p AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY CASE WHEN rc = 1 THEN 0 ELSE 1 END,
  CASE WHEN rc = 1 THEN intent END, CASE WHEN rc > 1 THEN -dur END, intent, pos) AS r FROM c)
SELECT speaker, intent, dur, l_orderkey, row_number() OVER (PARTITION BY speaker ORDER BY intent, r) - 1 AS ref_idx FROM p WHERE r <= 8""",
)
def f3(t):
    d = selection.pick_diverse(clips(t), "speaker", "intent", "dur", ORDER)
    return d.select("speaker", "intent", "dur", "l_orderkey", "ref_idx")


@query(
    "f4_pick_until",
    f"""WITH {CLIPS_SQL}, d AS (SELECT speaker, pos, l_orderkey, CAST(dur AS DECIMAL(18,6)) AS d FROM clips),
c AS (SELECT *, sum(d + 0.15) OVER (PARTITION BY speaker ORDER BY pos) AS cum FROM d),
s AS (SELECT speaker, min(pos) AS stop FROM c WHERE cum - d - 0.15 >= 6 OR (cum - 0.15 > 9 AND cum - d - 0.15 >= 5) GROUP BY 1),
k AS (SELECT c.* FROM c LEFT JOIN s USING (speaker) WHERE stop IS NULL OR pos < stop)
SELECT speaker, l_orderkey, CAST(d AS DOUBLE) AS dur, CAST(max(cum) OVER (PARTITION BY speaker) AS DOUBLE) AS total_s FROM k
WHERE speaker IN (SELECT speaker FROM k GROUP BY 1 HAVING max(cum) >= 5)""",
)
def f4(t):
    d = selection.pick_until(clips(t), "speaker", "dur", [F.col(c) for c in ORDER])
    return d.select("speaker", "l_orderkey", "dur", F.col("total_s").cast("double").alias("total_s"))


@query(
    "f7_round_robin",
    "SELECT o_orderkey % 11 AS speaker, (o_orderkey // 11) % 8 AS ref_idx, count(*) AS n FROM orders GROUP BY 1, 2",
)
def f7(t):
    d = selection.round_robin(t.orders.select("o_orderkey"), "o_orderkey", 11, 8)
    return d.groupBy("speaker", "ref_idx").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f8_first_seen",
    "SELECT md5(lower(trim(text))) AS k, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1",
)
def f8(t):
    d = t.documents.select(F.md5(F.lower(F.trim("text"))).alias("k"), "doc_id", "source")
    return first_seen(d, ["k"], ["doc_id"])
