"""Contamination: shared n-grams and best match over all originals."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.operators import contamination
from uttermark.operators.order import exact_percentiles
from uttermark.plans.registry import SQL_WORD, query
from uttermark.plans.text import DOC_WORDS
from uttermark.session import sized


def _gram_sql(max_n):
    sides = []
    for side, table in (("c", "documents"), ("o", "benchmark")):
        for n in range(1, max_n + 1):
            sides.append(
                f"SELECT DISTINCT '{side}' AS side, {n} AS n, unnest(list_transform(range(1, len(k) - {n} + 2), "
                f"lambda i: array_to_string(k[i:i+{n}-1], ' '))) AS gram FROM (SELECT {DOC_WORDS} AS k FROM {table}) WHERE len(k) >= {n}"
            )
    return f"""g AS ({" UNION ALL ".join(sides)}),
f AS (SELECT n, gram, bool_or(side = 'c') AS c, bool_or(side = 'o') AS o FROM g GROUP BY 1, 2)"""


@query(
    "e4_ngram_jaccard",
    f"""WITH {_gram_sql(5)}
SELECT n, count(*) FILTER (WHERE c) AS cand_unique, count(*) FILTER (WHERE o) AS orig_unique,
  count(*) FILTER (WHERE c AND o) AS shared, round(count(*) FILTER (WHERE c AND o) / count(*), 6) AS jaccard
FROM f GROUP BY n""",
)
def e4(t):
    d = contamination.ngram_jaccard(t.wide("documents", "text"), t.benchmark, "text")
    return d.withColumn("jaccard", F.round("jaccard", 6))


@query(
    "h4_ngram_sets",
    f"""WITH {_gram_sql(2)}
SELECT CASE WHEN c AND o THEN 'both' WHEN c THEN 'first' ELSE 'second' END AS part, count(*) AS n_grams
FROM f WHERE n = 2 GROUP BY 1""",
)
def h4(t):
    d = contamination.ngram_sets(t.wide("documents", "text"), t.benchmark, "text", 2)
    part = F.when(F.col("sides") == 3, "both").when(F.col("sides") == 1, "first").otherwise("second")
    return d.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_grams"))


def utterances(t):
    return t.conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("utt_id"), "text"
    )


BLEU_TOKENS = r"""list_filter(regexp_split_to_array(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' ||
    replace(replace(replace(replace(replace(replace(replace(regexp_replace(text, '[\s\p{Z}]+$', ''),
      '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' ',
    '([\{-\~\[-\` -\&\(-\+\:-\@\/])', ' \1 ', 'g'),
    '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'),
  '[\s\p{Z}]+'), lambda k: k <> '')"""


def _gram_counts(words, source, key, name, n):
    """CTEs: the tokens of each text with the three after them, and counts of its n-grams."""
    grams = ["t1", "t1 || chr(1) || t2", "t1 || chr(1) || t2 || chr(1) || t3", "t1 || chr(1) || t2 || chr(1) || t3 || chr(1) || t4"]
    each = " UNION ALL ".join(f"SELECT {key}, {i} AS n, {g} AS g FROM {words}" for i, g in enumerate(grams, start=1))
    return f"""{words} AS (SELECT {key}, t1, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3, lead(t1, 3) OVER w AS t4
  FROM (SELECT {key}, unnest(k) AS t1, generate_subscripts(k, 1) AS i FROM {source}) WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name} AS (SELECT {key}, n, g, count(*) AS {n} FROM ({each}) WHERE g IS NOT NULL GROUP BY 1, 2, 3)"""


def _bleu_sql(cid, table):
    """CTEs that end in ``bleu(cid, best)``."""
    return f"""c AS (SELECT {cid} AS cid, {BLEU_TOKENS} AS k FROM {table}),
o AS (SELECT item_id AS oid, {BLEU_TOKENS} AS k FROM benchmark),
{_gram_counts('cw', 'c', 'cid', 'cg', 'x')},
{_gram_counts('ow', 'o', 'oid', 'og', 'y')},
mt AS (SELECT cid, oid, sum(CASE WHEN n = 1 THEN least(x, y) ELSE 0 END) AS m1, sum(CASE WHEN n = 2 THEN least(x, y) ELSE 0 END) AS m2,
  sum(CASE WHEN n = 3 THEN least(x, y) ELSE 0 END) AS m3, sum(CASE WHEN n = 4 THEN least(x, y) ELSE 0 END) AS m4
  FROM cg JOIN og USING (n, g) GROUP BY 1, 2),
s AS (SELECT cid, len(c.k) AS m, len(o.k) AS r, m1, m2, m3, m4,
  CASE WHEN m2 = 0 THEN 1 ELSE 0 END AS z2, CASE WHEN m2 = 0 THEN 1 ELSE 0 END + CASE WHEN m3 = 0 THEN 1 ELSE 0 END AS z3,
  CASE WHEN m2 = 0 THEN 1 ELSE 0 END + CASE WHEN m3 = 0 THEN 1 ELSE 0 END + CASE WHEN m4 = 0 THEN 1 ELSE 0 END AS z4
  FROM mt JOIN c USING (cid) JOIN o USING (oid)),
b AS (SELECT cid, 100.0 * CASE WHEN m < r THEN exp(1.0 - CAST(r AS DOUBLE) / m) ELSE 1.0 END * exp((ln(m1 / m)
  + CASE WHEN m > 1 THEN ln(CASE WHEN m2 > 0 THEN m2 / (m - 1) ELSE 1.0 / (pow(2, z2) * (m - 1)) END) ELSE 0 END
  + CASE WHEN m > 2 THEN ln(CASE WHEN m3 > 0 THEN m3 / (m - 2) ELSE 1.0 / (pow(2, z3) * (m - 2)) END) ELSE 0 END
  + CASE WHEN m > 3 THEN ln(CASE WHEN m4 > 0 THEN m4 / (m - 3) ELSE 1.0 / (pow(2, z4) * (m - 3)) END) ELSE 0 END) / least(m, 4)) AS score FROM s),
bleu AS (SELECT c.cid AS cid, coalesce(max(score), 0.0) AS best FROM c LEFT JOIN b ON b.cid = c.cid GROUP BY 1)"""


TURN_ID = "conv_id || ':' || turn"


@query("d9_max_bleu4", f"WITH {_bleu_sql('doc_id', 'documents')} SELECT cid AS doc_id, round(best, 5) AS best FROM bleu")
def d9(t):
    d = contamination.max_bleu4(t.wide("documents", "doc_id", "text"), t.benchmark, "text", "doc_id")
    return d.select("doc_id", F.round("best", 5).alias("best"))


@query("d9_max_bleu4_turns", f"WITH {_bleu_sql(TURN_ID, 'conversations')} SELECT cid AS utt_id, round(best, 5) AS best FROM bleu")
def d9_turns(t):
    d = contamination.max_bleu4(utterances(t), t.benchmark, "text", "utt_id")
    return d.select("utt_id", F.round("best", 5).alias("best"))


def _rouge_sql(cid, table):
    """CTEs that end in ``rouge(cid, best)``: the longest common subsequence by one bit for each
    place of the original, which holds originals of up to 120 tokens."""
    return f"""rc AS (SELECT {cid} AS cid, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM {table}),
ro AS (SELECT item_id AS oid, regexp_extract_all(lower(text), '[a-z0-9]+') AS k FROM benchmark),
rp AS (SELECT oid, tok, sum(CAST(1 AS HUGEINT) << CAST(i AS HUGEINT))::HUGEINT AS bits
  FROM (SELECT oid, unnest(k) AS tok, generate_subscripts(k, 1) - 1 AS i FROM ro) GROUP BY 1, 2),
rh AS (SELECT cid, oid, list(bits ORDER BY i) AS hits
  FROM (SELECT cid, unnest(k) AS tok, generate_subscripts(k, 1) AS i FROM rc) JOIN rp USING (tok) GROUP BY 1, 2),
rl AS (SELECT cid, oid, len(ro.k) AS n, (CAST(1 AS HUGEINT) << CAST(len(ro.k) AS HUGEINT)) - 1 AS full_,
  list_prepend((CAST(1 AS HUGEINT) << CAST(len(ro.k) AS HUGEINT)) - 1, hits) AS hits FROM rh JOIN ro USING (oid)),
rs AS (SELECT cid, oid, n, n - bit_count(list_reduce(hits, lambda v, h: ((v + (v & h)) | (v - (v & h))) & full_)) AS lcs FROM rl),
rouge AS (SELECT rc.cid AS cid, coalesce(max(2.0 * lcs / (len(rc.k) + n)), 0.0) AS best FROM rc LEFT JOIN rs ON rs.cid = rc.cid GROUP BY 1)"""


@query("d8_max_rouge_l", f"WITH {_rouge_sql('doc_id', 'documents')} SELECT cid AS doc_id, round(best, 6) AS best FROM rouge")
def d8(t):
    d = contamination.max_rouge_l(t.wide("documents", "doc_id", "text"), t.benchmark, "text", "doc_id")
    return d.select("doc_id", F.round("best", 6).alias("best"))


@query("d8_max_rouge_l_turns", f"WITH {_rouge_sql(TURN_ID, 'conversations')} SELECT cid AS utt_id, round(best, 6) AS best FROM rouge")
def d8_turns(t):
    d = contamination.max_rouge_l(utterances(t), t.benchmark, "text", "utt_id")
    return d.select("utt_id", F.round("best", 6).alias("best"))


@query(
    "e5_score_summary",
    """SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90,
  round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, event_type FROM events GROUP BY event_type""",
)
def e5(t):
    return score_summary(t.events, "value", ["event_type"])


def score_summary(df, x, by):
    base = df.groupBy(*by).agg(F.round(F.avg(x), 6).alias("mean"), F.max(x).alias("max"))
    q = exact_percentiles(df, by, x, {"p50": 50, "p90": 90, "p99": 99})
    q = q.select(*by, *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])
    return base.join(q, by) if by else base.crossJoin(q)  # without groups both are one row


@query(
    "contamination_report",
    f"""WITH {_gram_sql(5)},
j AS (SELECT n, round(count(*) FILTER (WHERE c AND o) / count(*), 6) AS v FROM f GROUP BY n),
nrm AS (SELECT array_to_string({DOC_WORDS}, ' ') AS k FROM documents),
have AS (SELECT DISTINCT array_to_string(regexp_extract_all(lower(text), {SQL_WORD}), ' ') AS k FROM benchmark),
{_rouge_sql('doc_id', 'documents')}, {_bleu_sql('doc_id', 'documents')},
scores AS (SELECT 'rouge_l' AS name, best FROM rouge UNION ALL SELECT 'bleu4', best FROM bleu)
SELECT 'jaccard_' || n AS metric, v AS value FROM j
UNION ALL SELECT 'exact_match_pct', round(100.0 * count(have.k) / count(*), 6) FROM nrm LEFT JOIN have ON have.k = nrm.k
UNION ALL SELECT name || '_mean', round(avg(best), 4) FROM scores GROUP BY name
UNION ALL SELECT name || '_p50', round(quantile_cont(best, 0.5), 4) FROM scores GROUP BY name
UNION ALL SELECT name || '_p90', round(quantile_cont(best, 0.9), 4) FROM scores GROUP BY name
UNION ALL SELECT name || '_p99', round(quantile_cont(best, 0.99), 4) FROM scores GROUP BY name
UNION ALL SELECT name || '_max', round(max(best), 4) FROM scores GROUP BY name""",
)
def report(t):
    j = contamination.ngram_jaccard(t.wide("documents", "text"), t.benchmark, "text")
    m = contamination.exact_match_rate(t.documents, t.benchmark, "text")
    a = j.select(
        F.concat(F.lit("jaccard_"), F.col("n")).alias("metric"), F.round("jaccard", 6).alias("value")
    )
    b = m.select(F.lit("exact_match_pct").alias("metric"), F.round("match_pct", 6).alias("value"))
    docs = t.wide("documents", "doc_id", "text")
    best = contamination.max_scores(docs, t.benchmark, "text", "doc_id")
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("best")) for c in ("rouge_l", "bleu4")])
    return a.unionByName(b).unionByName(score_rows(best.select(F.inline(each))))


def score_rows(scores):
    """Mean, percentiles and maximum of ``name, best``, one row ``metric, value`` each."""
    scores = sized(scores, "scores")
    wide = score_summary(scores, "best", ["name"])
    each = F.array(*[F.struct(F.concat_ws("_", "name", F.lit(c)).alias("metric"), F.round(c, 4).alias("value")) for c in ("mean", "p50", "p90", "p99", "max")])
    return wide.select(F.inline(each))
