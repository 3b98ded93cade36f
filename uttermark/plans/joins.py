"""Joins: presence, inventories, lookups, matching, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.functions import tags
from uttermark.operators import contamination, labels, match, similarity
from uttermark.operators.order import sequence_ids
from uttermark.plans.registry import SQL_WORD, TAGGED_SQL, query, spans_sql
from uttermark.session import literal_table

NORM = f"array_to_string(regexp_extract_all(lower(text), {SQL_WORD}), ' ')"


def doc_lines(t):
    return t.documents.select(F.explode(F.split("text", "\n")).alias("text"))


@query(
    "d1_exact_match_rate",
    f"""WITH c AS (SELECT 'documents' AS kind, text FROM documents
  UNION ALL SELECT 'lines', unnest(string_split(text, chr(10))) FROM documents
  UNION ALL SELECT 'turns', text FROM conversations),
o AS (SELECT DISTINCT {NORM} AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)),
m AS (SELECT kind, o.norm IS NOT NULL AS hit FROM (SELECT kind, {NORM} AS norm FROM c) x LEFT JOIN o USING (norm))
SELECT kind, count(*) AS n_candidates, count(*) FILTER (WHERE hit) AS n_matches,
  round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS match_pct FROM m GROUP BY kind""",
)
def d1(t):
    originals = t.benchmark.select(F.explode(F.split("text", "\n")).alias("text"))
    parts = None
    for kind, c in (
        ("documents", t.documents.select("text")),
        ("lines", doc_lines(t)),
        ("turns", t.conversations.select("text")),
    ):
        r = contamination.exact_match_rate(c, originals, "text")
        r = r.select(
            F.lit(kind).alias("kind"), "n_candidates", "n_matches",
            F.round("match_pct", 6).alias("match_pct"),
        )
        parts = r if parts is None else parts.unionByName(r)
    return parts


ORDERS_EXPECTED = "o_orderstatus <> 'P'"


@query(
    "d2_missing_keys",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""",
)
def d2(t):
    actual = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return match.missing_keys(t.orders.select("o_orderkey"), actual, "o_orderkey")


@query(
    "d2_missing_generated_ids",
    """SELECT CAST(r.id AS BIGINT) AS id FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) + 1 FROM lineitem))) AS id) r
WHERE r.id NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def d2_ids(t):
    """Ids still to be generated: all of 0..max that have no row yet."""
    have = t.lineitem.select(F.col("l_orderkey").alias("id"))
    top = have.agg(F.max("id").alias("hi"))
    # The range is cut into chunks as rows, so no task has to build all of it.
    chunks = top.select(F.explode(F.expr("sequence(0L, hi div 10000)")).alias("c"), "hi")
    ids = chunks.repartition("c").select(
        F.explode(F.expr("sequence(c * 10000, least(c * 10000 + 9999, hi))")).alias("id")
    )
    return match.missing_keys(ids, have, "id")


@query(
    "d3_diff_inventory",
    f"""WITH e AS (SELECT o_orderkey AS k FROM orders WHERE {ORDERS_EXPECTED}), a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
d AS (SELECT 'missing' AS side, k FROM (SELECT k FROM e EXCEPT SELECT k FROM a)
  UNION ALL SELECT 'extra', k FROM (SELECT k FROM a EXCEPT SELECT k FROM e))
SELECT side, count(*) AS n_keys, array_to_string((list(k ORDER BY k))[1:10], ',') AS examples FROM d GROUP BY side""",
)
def d3(t):
    expected = t.orders.where(ORDERS_EXPECTED).select(F.col("o_orderkey").alias("k"))
    actual = t.lineitem.select(F.col("l_orderkey").alias("k"))
    d = match.diff_inventory(expected, actual, "k")
    return d.withColumn("examples", F.array_join("examples", ","))


@query(
    "d4_overlap_partition",
    """WITH tr AS (SELECT DISTINCT lower(trim(text)) AS k FROM documents WHERE doc_id % 2 = 1),
te AS (SELECT lower(trim(text)) AS k, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END AS correct FROM documents WHERE doc_id % 2 = 0)
SELECT CASE WHEN tr.k IS NULL THEN 'novel' ELSE 'overlap' END AS part, count(*) AS n, count(DISTINCT te.k) AS n_unique,
  round(avg(correct), 6) AS accuracy FROM te LEFT JOIN tr USING (k) GROUP BY 1""",
)
def d4(t):
    d = t.documents
    test = d.where("doc_id % 2 = 0").withColumn("correct", (F.col("n_chars") % 3 == 0).cast("int"))
    parts = match.overlap_partition(test, d.where("doc_id % 2 = 1"), "text")
    texts = parts.withColumn("k", F.md5(F.lower(F.trim("text"))))
    # Distinct texts by a first aggregate per text, not by a set per part.
    per_text = texts.groupBy("part", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("c")
    )
    return per_text.groupBy("part").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        F.round(F.sum("c") / F.sum("n"), 6).alias("accuracy"),
    )


CANON = r"trim(regexp_replace(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g')), '[.?!]+$', ''))"


@query(
    "d5_attach_by_text",
    f"""WITH f AS (SELECT {CANON} AS k, min(doc_id) AS first_id FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT d.doc_id, CASE WHEN f.first_id IS NOT NULL THEN 'doc_' || f.first_id || '.wav' END AS file
FROM (SELECT doc_id, {CANON} AS k FROM documents WHERE doc_id % 2 = 0) d LEFT JOIN f USING (k)""",
)
def d5(t):
    d = t.documents
    files = d.where("doc_id % 2 = 1").select(
        "text", "doc_id", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".wav")).alias("file")
    )
    left = d.where("doc_id % 2 = 0").select("doc_id", "text")
    out = match.attach_by_text(left, files.withColumnRenamed("doc_id", "pos"), "text", "file", ["pos"])
    return out.select("doc_id", "file")


@query(
    "d6_attach_by_position",
    """WITH f AS (SELECT printf('cmd_%04d_en.wav', page_id * 3) AS file FROM pages),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, printf('cmd_%04d_en.wav', pos) AS file, f.file IS NOT NULL AS found
FROM r LEFT JOIN f ON f.file = printf('cmd_%04d_en.wav', pos)""",
)
def d6(t):
    files = t.pages.select(F.format_string("cmd_%04d_en.wav", F.col("page_id") * 3).alias("file"))
    rows = sequence_ids(t.documents.select("doc_id"), "doc_id").withColumn("pos", F.col("rn") - 1)
    d = match.attach_by_position(rows, files, "pos", "cmd_%04d_en.wav")
    return d.select("doc_id", "file", "found")


@query(
    "d7_lookup",
    """SELECT coalesce(x.translated, n_name) AS nation, coalesce(r_name, '?') AS region, count(*) AS n_customers
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (VALUES ('NATION_1', 'Pays 1'), ('NATION_7', 'Pays 7')) x(n_name, translated) USING (n_name)
GROUP BY 1, 2""",
)
def d7(t):
    words = literal_table(
        t.spark, "n_name string, translated string", [("NATION_1", "Pays 1"), ("NATION_7", "Pays 7")]
    )
    d = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n_customers")
    )
    d = labels.lookup(d, t.nation, "n_nationkey", {"n_name": "?"})
    d = labels.lookup(d.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey", {"r_name": "?"})
    d = labels.lookup(d, words, "n_name", {"translated": F.col("n_name")})
    return d.groupBy(F.col("translated").alias("nation"), F.col("r_name").alias("region")).agg(
        F.sum("n_customers").alias("n_customers")
    )


def slot_pairs(t):
    """Gold and predicted slot values of each turn, cut from two tag rules."""

    def slots(tag_col):
        def slot(k, s):
            return F.struct(s["label"].alias("slot_name"), tags.span_text(k, s).alias("raw_value"))

        return tags.span_values(F.col("tokens"), F.col(tag_col), slot)

    role = F.col("role")
    return t.tagged.select(
        "utt_id",
        "text",
        role.alias("gold_intent"),
        F.when(F.size("tokens") % 7 == 0, F.lit(None).cast("string"))
        .when(F.size("tokens") % 5 == 0, F.lit("system"))
        .otherwise(role)
        .alias("pred_intent"),
        slots("gold").alias("gold_slots"),
        slots("pred").alias("pred_slots"),
    )


SLOT_PAIRS_SQL = f"""{TAGGED_SQL}, {spans_sql("gold", "gs")}, {spans_sql("pred", "ps")},
intents AS (SELECT utt_id, text, role AS gold_intent, CASE WHEN len(tokens) % 7 = 0 THEN NULL
  WHEN len(tokens) % 5 = 0 THEN 'system' ELSE role END AS pred_intent FROM tagged),
gv AS (SELECT utt_id, label AS slot_name, array_to_string(tokens[s + 1:e], ' ') AS v, count(*) AS g
  FROM gs JOIN tagged USING (utt_id) GROUP BY 1, 2, 3),
pv AS (SELECT utt_id, label AS slot_name, array_to_string(tokens[s + 1:e], ' ') AS v, count(*) AS p
  FROM ps JOIN tagged USING (utt_id) GROUP BY 1, 2, 3)"""

BAG_SQL = """bag AS (SELECT utt_id, slot_name,
  CAST(sum(least(coalesce(g, 0), coalesce(p, 0))) AS BIGINT) AS tp,
  CAST(sum(greatest(coalesce(p, 0) - coalesce(g, 0), 0)) AS BIGINT) AS fp,
  CAST(sum(greatest(coalesce(g, 0) - coalesce(p, 0), 0)) AS BIGINT) AS fn
  FROM gv FULL JOIN pv USING (utt_id, slot_name, v) GROUP BY 1, 2)"""


@query("d10_bag_match", f"WITH {SLOT_PAIRS_SQL}, {BAG_SQL} SELECT * FROM bag")
def d10(t):
    return match.bag_match(slot_pairs(t), ["utt_id"], "gold_slots", "pred_slots")


RULES = {
    "user": ["tion.*ing", "wher"],
    "assistant": ["^to ", "hath", "ing"],
    "system": ["ou are", "edre"],
}


def _rule_sql(role):
    arms = " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{p}'" for p in RULES[role])
    return f"SELECT conv_id, turn, role, '{role}' AS suggested, CASE {arms} END AS pattern FROM c WHERE role <> '{role}'"


@query(
    "d11_keyword_confusion",
    "WITH c AS (SELECT * FROM conversations) SELECT * FROM ("
    + " UNION ALL ".join(_rule_sql(r) for r in RULES)
    + ") WHERE pattern IS NOT NULL",
)
def d11(t):
    c = t.conversations
    d = match.keyword_confusion(c, "text", "role", RULES)
    return d.select("conv_id", "turn", "role", "suggested", "pattern")


@query(
    "d12_coverage_by_group",
    """WITH k AS (SELECT DISTINCT l_returnflag AS grp, l_orderkey AS k FROM lineitem),
b AS (SELECT k FROM k WHERE grp = 'N')
SELECT grp, count(*) AS n_keys, count(b.k) AS n_shared, count(*) - count(b.k) AS n_extra,
  (SELECT count(*) FROM b) - count(b.k) AS n_missing, round(100.0 * count(b.k) / (SELECT count(*) FROM b), 6) AS coverage_pct
FROM (SELECT * FROM k WHERE grp <> 'N') o LEFT JOIN b ON b.k = o.k GROUP BY grp""",
)
def d12(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("k"))
    out = match.coverage_by_group(d, "k", "grp", "N")
    return out.withColumn("coverage_pct", F.round("coverage_pct", 6))


def _results(t, where, a, b):
    return t.customer.where(where).groupBy(F.col("c_nationkey").alias("lang")).agg(
        F.round(F.avg("c_acctbal"), 4).alias(a), F.count(F.lit(1)).alias(b)
    )


@query(
    "d13_upsert",
    """WITH o AS (SELECT c_nationkey AS lang, round(avg(c_acctbal), 4) AS score, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1),
w AS (SELECT c_nationkey AS lang, round(avg(c_acctbal), 4) AS score, count(*) AS n FROM customer WHERE c_nationkey > 8 AND c_acctbal > 0 GROUP BY 1)
SELECT lang, coalesce(w.score, o.score) AS score, coalesce(o.n, w.n) AS n FROM o FULL JOIN w USING (lang)""",
)
def d13(t):
    old = _results(t, "c_nationkey < 15", "score", "n")
    new = _results(t, "c_nationkey > 8 AND c_acctbal > 0", "score", "n")
    return match.upsert(old, new, "lang", ["score"], ["n"])


@query(
    "d14_merge_gazetteers",
    """WITH a AS (SELECT DISTINCT p_type AS entity, p_name AS value FROM part WHERE p_size <= 10),
b AS (SELECT p_type AS entity, upper(p_name) AS value, lower(p_name) AS k FROM part WHERE p_size > 5)
SELECT entity, value, 'a' AS origin FROM a
UNION ALL SELECT DISTINCT entity, value, 'b' FROM b WHERE (entity, k) NOT IN (SELECT entity, lower(value) FROM a)""",
)
def d14(t):
    p = t.part
    a = p.where("p_size <= 10").select(F.col("p_type").alias("entity"), F.col("p_name").alias("value")).distinct()
    b = p.where("p_size > 5").select(
        F.col("p_type").alias("entity"), F.upper("p_name").alias("value"), F.col("p_partkey").alias("pos")
    )
    return match.merge_gazetteers(a, b)


@query(
    "d15_pairwise_centroid_cosine",
    """WITH x AS (SELECT label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(CAST(a AS DOUBLE)) AS x FROM x GROUP BY 1, 2)
SELECT a.label AS label_a, b.label AS label_b,
  round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) + 1e-9) / (sqrt(sum(b.x * b.x)) + 1e-9), 6) AS cosine
FROM c a JOIN c b ON a.d = b.d AND a.label < b.label GROUP BY 1, 2""",
)
def d15(t):
    c = similarity.centroids(t.embeddings, ["label"], "embedding")
    d = similarity.pairwise_centroid_cosine(c, "label")
    return d.withColumn("cosine", F.round("cosine", 6))


@query(
    "d15_mean_centroid_cosine",
    """WITH x AS (SELECT label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(CAST(a AS DOUBLE)) AS x FROM x GROUP BY 1, 2),
p AS (SELECT a.label, b.label AS other, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) + 1e-9) / (sqrt(sum(b.x * b.x)) + 1e-9) AS cosine
  FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY 1, 2)
SELECT label, round(avg(cosine), 6) AS mean_cosine FROM p GROUP BY 1""",
)
def d15_mean(t):
    c = similarity.centroids(t.embeddings, ["label"], "embedding")
    d = similarity.mean_centroid_cosine(c, "label")
    return d.withColumn("mean_cosine", F.round("mean_cosine", 6))


@query(
    "a12_pending",
    """SELECT DISTINCT event_type, user_id FROM events e WHERE NOT EXISTS
  (SELECT 1 FROM events d WHERE d.value > 150 AND d.event_type = e.event_type AND d.user_id = e.user_id)""",
)
def a12(t):
    """Resume: keys of earlier output are left out of the work to be done."""
    work = t.events.select("event_type", "user_id").distinct()
    return match.pending(work, t.events.where("value > 150"), ["event_type", "user_id"])
