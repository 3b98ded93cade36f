"""Filters and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.functions import tags
from uttermark.functions.text import space_tokens
from uttermark.operators import filters, labels
from uttermark.plans.registry import GOLD_SQL, TAGGED_SQL, TURNS_SQL, gold_tag, query
from uttermark.plans.text import languages
from uttermark.session import literal_table


@query(
    "c1_keep",
    "SELECT doc_id, source FROM documents WHERE lang = 'en' AND trim(coalesce(text, '')) <> ''",
)
def c1(t):
    return filters.keep(t.documents, lang="en", non_empty=("text",)).select("doc_id", "source")


SPACE_TAGS_SQL = f"""{TURNS_SQL}, st AS (
  SELECT utt_id, tokens, list_transform(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}]+'), lambda k: k <> ''),
    lambda t: {GOLD_SQL}) AS tags FROM turns)"""


def space_tagged(t):
    """Tags made on white-space tokens, to be fitted to word tokens."""
    return t.turns.select(
        "utt_id", "tokens", F.transform(space_tokens(F.col("text")), gold_tag).alias("tags")
    )


@query(
    "c2_align_tags",
    f"""WITH {SPACE_TAGS_SQL}
SELECT utt_id, array_to_string(list_concat(tags, list_transform(tokens, lambda x: 'O'))[1:len(tokens)], ' ') AS aligned FROM st""",
)
def c2(t):
    d = space_tagged(t)
    return d.select(
        "utt_id", F.array_join(tags.align_tags(F.col("tokens"), F.col("tags")), " ").alias("aligned")
    )


@query(
    "c3_check_bio",
    f"""WITH {SPACE_TAGS_SQL}, u AS (
  SELECT utt_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM st),
v AS (SELECT *, lag(tag) OVER (PARTITION BY utt_id ORDER BY pos) AS prev FROM u),
w AS (SELECT utt_id, arg_min(tag, pos) AS bad FROM v WHERE tag LIKE 'I-%' AND
  (CASE WHEN prev LIKE 'B-%' OR prev LIKE 'I-%' THEN substr(prev, 3) ELSE '' END) <> substr(tag, 3) GROUP BY 1),
r AS (SELECT st.utt_id, CASE WHEN len(tokens) <> len(tags)
    THEN 'lengths:' || len(tokens) || '/' || len(tags)
    WHEN bad IS NULL THEN '' ELSE 'opens-inside:' || bad END AS bio_reason
  FROM st LEFT JOIN w ON w.utt_id = st.utt_id)
SELECT utt_id, bio_reason, bio_reason = '' AS bio_ok FROM r""",
)
def c3(t):
    d = filters.check_bio(space_tagged(t), "tokens", "tags")
    return d.select("utt_id", "bio_reason", "bio_ok")


@query(
    "c4_in_range",
    "SELECT event_id, value FROM events WHERE value BETWEEN 5 AND 12",
)
def c4(t):
    return filters.in_range(t.events, "value", 5.0, 12.0).select("event_id", "value")


@query(
    "c5_drop_label",
    """SELECT lang, source, count(*) AS n FROM documents
WHERE NOT (lang = 'de' AND source = 'src_1') AND NOT (lang = 'fr' AND source = 'src_2')
GROUP BY 1, 2""",
)
def c5(t):
    config = literal_table(
        t.spark, "lang string, excluded string", [("de", "SRC_1"), ("fr", "Src_2"), ("en", None)]
    )
    d = filters.drop_label(t.documents, config, "lang", "source")
    return d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c6_assert_complete",
    """SELECT count(*) AS n_expected, count(*) FILTER (WHERE l_orderkey IS NULL) AS n_missing
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey""",
)
def c6(t):
    listing = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.assert_complete(t.orders.select("o_orderkey"), listing, "o_orderkey")


@query(
    "c7_default_tags",
    f"""WITH {TAGGED_SQL}
SELECT utt_id, array_to_string(CASE WHEN role = 'user' AND len(gold) > 0 THEN gold ELSE list_transform(tokens, lambda x: 'O') END, ' ') AS tags FROM tagged""",
)
def c7(t):
    given = F.when(F.col("role") == "user", F.col("gold"))
    return t.tagged.select(
        "utt_id", F.array_join(tags.default_tags(F.col("tokens"), given), " ").alias("tags")
    )


@query(
    "c8_resolve_language",
    """SELECT CASE WHEN lang = 'es' THEN 'en' ELSE lang END AS language_code, count(*) AS n FROM documents GROUP BY 1""",
)
def c8(t):
    """Names and codes in mixed case; Spanish is given an unknown name and falls to 'en'."""
    name = (
        F.when(F.col("lang") == "en", "English")
        .when(F.col("lang") == "fr", " FRENCH ")
        .when(F.col("lang") == "de", "DE")
        .otherwise("Elvish")
    )
    d = labels.resolve_language(t.documents.withColumn("language", name), languages(t.spark))
    return d.groupBy("language_code").agg(F.count(F.lit(1)).alias("n"))
