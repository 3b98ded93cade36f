"""Audits and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.functions.text import word_tokens
from uttermark.functions.util import unnest
from uttermark.operators import audit, vocab
from uttermark.operators.order import exact_percentiles, first_n, most_common
from uttermark.plans.registry import TAGGED_SQL, TURNS_SQL, query, spans_sql
from uttermark.plans.text import DOC_WORDS
from uttermark.session import literal_table


@query(
    "e1_counts_and_shares",
    """SELECT lang, source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS share_pct
FROM documents GROUP BY 1, 2""",
)
def e1(t):
    d = audit.counts_and_shares(t.documents, ["lang", "source"])
    return d.withColumn("share_pct", F.round("share_pct", 6))


SPLIT_OF_TURN = "CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'dev' ELSE 'test' END"


def corpus(t):
    """Tagged turns as a corpus: role as language, a fixed conversation split, an intent."""
    return t.tagged.select(
        "utt_id",
        F.col("role").alias("lang"),
        F.expr(SPLIT_OF_TURN).alias("split"),
        F.concat(F.lit("Intent"), (F.col("turn") % 4).cast("string")).alias("intent"),
        "tokens",
        F.col("gold").alias("tags"),
        "text",
    )


CORPUS_SQL = f"""{TAGGED_SQL}, corpus AS (SELECT utt_id, role AS lang, {SPLIT_OF_TURN} AS split,
  'Intent' || (turn % 4) AS intent, tokens, gold AS tags, text FROM tagged)"""


@query(
    "e2_language_table",
    f"""WITH {CORPUS_SQL}, ty AS (SELECT lang, count(DISTINCT substr(tag, 3)) AS n_slot_types FROM
  (SELECT lang, unnest(tags) AS tag FROM corpus) WHERE tag LIKE 'B-%' OR tag LIKE 'I-%' GROUP BY 1)
SELECT lang, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'dev') AS n_dev,
  count(*) FILTER (WHERE split = 'test') AS n_test, count(DISTINCT lower(intent)) AS n_intents,
  coalesce(any_value(n_slot_types), 0) AS n_slot_types FROM corpus LEFT JOIN ty USING (lang) GROUP BY lang""",
)
def e2(t):
    return audit.language_table(corpus(t), ["train", "dev", "test"])


@query(
    "e3_length_stats",
    f"""WITH x AS (SELECT lang, len({DOC_WORDS}) AS n FROM documents)
SELECT lang, round(avg(n), 6) AS avg_tokens, CAST(min(n) AS INTEGER) AS min_tokens, CAST(max(n) AS INTEGER) AS max_tokens,
  CAST(sum(n) AS BIGINT) AS total_tokens FROM x GROUP BY lang""",
)
def e3(t):
    d = t.wide("documents", "lang", "text")
    d = audit.length_stats(d, ["lang"], F.size(word_tokens(F.col("text"))))
    return d.withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(
    "e7_index_percentile",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, value AS p90 FROM r WHERE rn = n * 9 // 10 + 1""",
)
def e7(t):
    return exact_percentiles(t.events, ["event_type"], "value", {"p90": 90}, kind="index")


@query(
    "e8_duplicate_texts",
    """SELECT md5(lower(trim(text))) AS text_md5, count(*) AS n_copies, count(DISTINCT source) AS n_labels
FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def e8(t):
    return audit.duplicate_texts(t.documents, "text", "source")


@query(
    "e19_build_vocab",
    f"""WITH w AS (SELECT unnest({DOC_WORDS}) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT word, row_number() OVER (ORDER BY n DESC, word) + 3 AS idx, n FROM c
UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, NULL), ('[UNK]', 1, NULL), ('[CLS]', 2, NULL), ('[SEP]', 3, NULL))""",
)
def e19(t):
    d = t.wide("documents", "text").select(word_tokens(F.col("text")).alias("tokens"))
    return vocab.build_vocab(d, "tokens", 2)


@query(
    "e20_label_vocab",
    f"""WITH {TAGGED_SQL}, seen AS (SELECT DISTINCT unnest(pred) AS label FROM tagged),
l AS (SELECT 'intent' AS kind, role AS label, 0 AS step FROM (SELECT DISTINCT role FROM tagged)
  UNION ALL SELECT 'tag', label, 0 FROM seen
  UNION ALL SELECT 'tag', 'I-' || substr(label, 3), 1 FROM seen WHERE label LIKE 'B-%' AND 'I-' || substr(label, 3) NOT IN (SELECT label FROM seen)
  UNION ALL SELECT 'tag', 'PAD', 2)
SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY step, label) - 1 AS idx FROM l""",
)
def e20(t):
    return audit.label_vocab(t.tagged, "role", "pred")


@query(
    "e21_projection_yield",
    f"""WITH {TAGGED_SQL}, x AS (SELECT role, len(list_filter(gold, lambda k: k LIKE 'B-%')) AS e, len(list_filter(pred, lambda k: k LIKE 'B-%')) AS f FROM tagged)
SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE f > 0) AS n_with_slots, CAST(sum(e) AS BIGINT) AS n_expected,
  CAST(sum(f) AS BIGINT) AS n_found, round(CASE WHEN sum(e) > 0 THEN 100.0 * sum(f) / sum(e) ELSE 0 END, 6) AS found_pct FROM x GROUP BY role""",
)
def e21(t):
    d = t.tagged.select(
        "role",
        F.size(F.filter("gold", lambda x: x.startswith("B-"))).alias("n_expected"),
        F.col("pred").alias("tags"),
    )
    d = audit.projection_yield(d, ["role"])
    return d.withColumn("found_pct", F.round("found_pct", 6))


@query(
    "e22_fix_report",
    f"""WITH {TAGGED_SQL}
SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE gold <> pred) AS n_changed,
  count(*) FILTER (WHERE len(tokens) <> len(pred)) AS n_mismatched,
  CAST(sum(len(list_filter(gold, lambda k: k LIKE 'B-%'))) AS BIGINT) AS slots_before,
  CAST(sum(len(list_filter(pred, lambda k: k LIKE 'B-%'))) AS BIGINT) AS slots_after FROM tagged GROUP BY role""",
)
def e22(t):
    d = t.tagged.select("role", "tokens", F.col("gold").alias("tags_before"), F.col("pred").alias("tags"))
    return audit.fix_report(d, ["role"])


@query(
    "e23_slot_fillers",
    f"""WITH {TAGGED_SQL}, {spans_sql("gold", "gs")}
SELECT DISTINCT label AS slot, array_to_string(tokens[s + 1:e], ' ') AS value
FROM gs JOIN tagged USING (utt_id) WHERE label <> 'mid' AND gold[s + 1] LIKE 'B-%'""",
)
def e23(t):
    return audit.slot_fillers(t.tagged, "tokens", "gold", exclude=("mid",))


@query(
    "e24_inventory_stats",
    """SELECT event_type AS grp, count(*) AS n_files, min(value) AS min_s, max(value) AS max_s, round(avg(value), 6) AS mean_s,
  round(stddev_samp(value), 6) AS stdev_s, round(sum(value) / 3600, 6) AS hours, CAST(sum(length(props)) AS BIGINT) AS bytes,
  round(median(value), 6) AS median_s FROM events GROUP BY 1""",
)
def e24(t):
    d = t.events.select(F.col("event_type").alias("grp"), "value", F.length("props").alias("size"))
    out = audit.inventory_stats(d, "value", "size", ["grp"])
    for c in ("mean_s", "stdev_s", "hours", "median_s"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query(
    "e25_opener_error_rate",
    r"""WITH o AS (SELECT coalesce(lower(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda k: k <> '')[1]), '') AS opener,
  CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END AS err FROM conversations)
SELECT opener, CAST(sum(err) AS BIGINT) AS n_errors, count(*) AS n_rows, round(sum(err) / count(*), 6) AS rate
FROM o GROUP BY 1 HAVING sum(err) > 0 ORDER BY sum(err) DESC, opener LIMIT 15""",
)
def e25(t):
    d = t.conversations.withColumn("err", F.length("text") % 3 == 0)
    out = audit.opener_error_rate(d, "text", "err")
    return out.withColumn("rate", F.round("rate", 6))


TARGETS = [("en", 620), ("fr", 145), ("de", 100), ("es", 104), ("hi", 50)]


@query(
    "e26_compare_targets",
    "WITH t(lang, target) AS (VALUES "
    + ", ".join(str(r) for r in TARGETS)
    + """), c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1)
SELECT lang, CAST(target AS BIGINT) AS target, coalesce(n, 0) AS n, coalesce(n, 0) - target AS diff,
  CASE WHEN abs(coalesce(n, 0) - target) <= 5 THEN 'OK' ELSE 'MISMATCH' END AS status FROM t LEFT JOIN c USING (lang)""",
)
def e26(t):
    targets = literal_table(t.spark, "lang string, target bigint", TARGETS)
    counts = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return audit.compare_targets(counts, targets, ["lang"])


@query(
    "e27_tag_quality",
    f"""WITH {TAGGED_SQL}, x AS (SELECT role, len(list_filter(pred, lambda k: k LIKE 'B-%')) = 0 AS none,
  CASE WHEN length(text) % 2 = 0 THEN 'x' ELSE ' ' END AS entity FROM tagged)
SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE none) AS n_all_o, count(*) FILTER (WHERE none AND trim(entity) <> '') AS n_entity_all_o
FROM x GROUP BY role""",
)
def e27(t):
    d = t.tagged.withColumn("entity", F.when(F.length("text") % 2 == 0, "x").otherwise(" "))
    return audit.tag_quality(d, ["role"], "pred", "entity")


@query(
    "e27_empty_texts",
    "SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS n_empty FROM documents GROUP BY 1",
)
def e27_empty(t):
    return audit.empty_texts(t.documents, ["source"], "text")


@query(
    "e28_slot_histogram",
    f"""WITH {TAGGED_SQL} SELECT substr(tag, 3) AS slot, count(*) AS n FROM (SELECT unnest(gold) AS tag FROM tagged) WHERE tag LIKE 'B-%' GROUP BY 1""",
)
def e28(t):
    return audit.slot_histogram(t.tagged, "gold")


@query(
    "e28_multi_slot_rows",
    f"""WITH {TAGGED_SQL} SELECT role, count(*) AS n_rows, count(*) FILTER (WHERE len(list_filter(gold, lambda k: k LIKE 'B-%')) >= 2) AS n_multi FROM tagged GROUP BY 1""",
)
def e28_multi(t):
    return audit.multi_slot_rows(t.tagged, ["role"], "gold")


FIRST = r"coalesce(lower(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda k: k <> '')[1]), '')"


@query(
    "e30_first_word_diversity",
    f"SELECT role, count(DISTINCT nullif({FIRST}, '')) AS n_first_words, count(*) AS n_rows FROM conversations GROUP BY 1",
)
def e30(t):
    return audit.first_word_diversity(t.conversations, ["role"], "text")


@query(
    "e30_keyword_share",
    """SELECT role, count(*) FILTER (WHERE k) AS n_hits, round(100.0 * count(*) FILTER (WHERE k) / count(*), 6) AS share_pct
FROM (SELECT role, contains(lower(text), 'hath') OR contains(lower(text), 'ent ') AS k FROM conversations) GROUP BY 1""",
)
def e30_kw(t):
    d = audit.keyword_share(t.conversations, ["role"], "text", ["hath", "ent "])
    return d.withColumn("share_pct", F.round("share_pct", 6))


@query(
    "g1_most_common",
    f"""WITH {TURNS_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM turns) GROUP BY 1 ORDER BY n DESC, word LIMIT 20""",
)
def g1(t):
    return most_common(unnest(t.turns, [], F.col("tokens"), "word"), ["word"], 20)


@query(
    "g2_first_n",
    "SELECT conv_id, turn, role FROM conversations WHERE length(text) % 3 = 0 ORDER BY conv_id, turn LIMIT 30",
)
def g2(t):
    bad = t.conversations.where(F.length("text") % 3 == 0).select("conv_id", "turn", "role")
    return first_n(bad, ["conv_id", "turn"], 30)


@query(
    "h1_mix",
    """SELECT origin, lang, count(*) AS n FROM (SELECT lang, 'real' AS origin FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT lang, 'synthetic' FROM documents WHERE doc_id % 3 > 0) GROUP BY 1, 2""",
)
def h1(t):
    d = t.documents.select("doc_id", "lang")
    m = vocab.mix(d.where("doc_id % 3 = 0"), d.where("doc_id % 3 > 0"))
    return m.groupBy("origin", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h2_unseen_values",
    f"""WITH {TURNS_SQL}, w AS (SELECT role, unnest(tokens) AS value FROM turns)
SELECT value, count(*) AS n FROM w WHERE role = 'user' AND value NOT IN ('the', 'and')
  AND value NOT IN (SELECT value FROM w WHERE role = 'assistant') GROUP BY 1""",
)
def h2(t):
    w = unnest(t.turns, ["role"], F.col("tokens"), "value")
    return vocab.unseen_values(
        w.where("role = 'user'"), w.where("role = 'assistant'"), "value", ["the", "and"]
    )


@query(
    "h3_vocab_diff",
    f"""WITH {TURNS_SQL}, w AS (SELECT DISTINCT role, unnest(tokens) AS value FROM turns)
SELECT value, CASE WHEN bool_or(role = 'user') THEN 'only_a' ELSE 'only_b' END AS side FROM w WHERE role IN ('user', 'system')
GROUP BY value HAVING count(DISTINCT role) = 1""",
)
def h3(t):
    w = unnest(t.turns, ["role"], F.col("tokens"), "value")
    return vocab.vocab_diff(w.where("role = 'user'"), w.where("role = 'system'"), "value")
