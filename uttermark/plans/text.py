"""Text scalars over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttermark.functions import numeric, text
from uttermark.operators import labels, similarity
from uttermark.operators.order import exact_percentiles
from uttermark.plans.registry import SQL_WORD, TURNS_SQL, query
from uttermark.session import literal_table

DOC_WORDS = f"regexp_extract_all(lower(text), {SQL_WORD})"


def fingerprint(tokens):
    return F.md5(F.array_join(tokens, " "))


@query(
    "b1_word_tokens",
    f"""WITH t AS (SELECT doc_id, {DOC_WORDS} AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM t""",
)
def b1(t):
    d = t.documents.select("doc_id", text.word_tokens(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"), fingerprint("tok").alias("digest"))


@query(
    "b2_normalize",
    f"SELECT utt_id, array_to_string(tokens, ' ') AS norm FROM (WITH {TURNS_SQL} SELECT * FROM turns)",
)
def b2(t):
    return t.turns.select("utt_id", text.normalize(F.col("text")).alias("norm"))


@query(
    "b3_char_tokens",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\p{Z}\s]') AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM t""",
)
def b3(t):
    d = t.documents.select("doc_id", text.char_tokens(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"), fingerprint("tok").alias("digest"))


# Language settings for the stand-in corpus; German plays the script without spaces.
LANGUAGES = [
    ("en", "English", "whitespace"),
    ("fr", "French", "whitespace"),
    ("es", "Spanish", "whitespace"),
    ("de", "German", "character"),
]


def languages(spark):
    return literal_table(spark, "code string, name string, tokenization string", LANGUAGES)


@query(
    "b4_tokens_by_language",
    rf"""WITH t AS (SELECT doc_id, lang, CASE WHEN lang = 'de'
  THEN regexp_extract_all(text, '[^\p{{Z}}\s]') ELSE {DOC_WORDS} END AS tok FROM documents)
SELECT lang, CAST(sum(len(tok)) AS BIGINT) AS n_tokens, count(*) AS n_docs FROM t GROUP BY lang""",
)
def b4(t):
    d = labels.tokens_by_language(t.documents, "text", "lang", languages(t.spark))
    return d.groupBy("lang").agg(
        F.sum(F.size("tokens")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs")
    )


@query(
    "b5_punct_tokens",
    rf"""WITH t AS (SELECT utt_id, regexp_extract_all(text,
  '[\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)?|[^\p{{L}}\p{{N}}_\s\p{{Z}}]') AS tok
  FROM (WITH {TURNS_SQL} SELECT * FROM turns))
SELECT utt_id, CAST(len(tok) AS INTEGER) AS n_tokens, array_to_string(tok, ' ') AS joined FROM t""",
)
def b5(t):
    d = t.turns.select("utt_id", text.punct_tokens(F.col("text")).alias("tok"))
    return d.select(
        "utt_id", F.size("tok").alias("n_tokens"), F.array_join("tok", " ").alias("joined")
    )


def contracted_sql(expr: str) -> str:
    out = f"lower({expr})"
    for short, long in text.CONTRACTIONS:
        quoted = short.replace("'", "''")
        out = f"replace({out}, '{quoted}', '{long}')"
    return out


CONTRACTED = contracted_sql("text")


@query(
    "b6_expand_contractions",
    rf"""WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN {CONTRACTED} ELSE lower(text) END AS x FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(x, '([\p{{L}}\p{{N}}_])\.', '\1', 'g'),
  '[\s\p{{Z}}]+', ' ', 'g'))) AS digest FROM t""",
)
def b6(t):
    x = text.expand_contractions(F.col("text"), F.col("lang"))
    return t.documents.select("doc_id", F.md5(x).alias("digest"))


@query(
    "b7_strip_accents",
    "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents",
)
def b7(t):
    return t.documents.select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("digest"))


# Letters of the texts put into other scripts, with and without accents.
LATIN, OTHERS = "aeioucdglrst", "άέίόύйЇёγλЌц"


@query(
    "b7_strip_accents_scripts",
    f"SELECT doc_id, md5(lower(strip_accents(translate(lower(text), '{LATIN}', '{OTHERS}')))) AS digest FROM documents",
)
def b7_scripts(t):
    """The same over Greek and Cyrillic letters."""
    other = F.translate(F.lower("text"), LATIN, OTHERS)
    return t.documents.select("doc_id", F.md5(text.strip_accents(other)).alias("digest"))


@query(
    "b8_strip_suffix",
    rf"""WITH {TURNS_SQL}
SELECT utt_id, array_to_string(list_transform(tokens, lambda k: regexp_replace(k, '''[\p{{L}}\p{{N}}_]*$', '')), ' ') AS joined
FROM turns""",
)
def b8(t):
    return t.turns.select("utt_id", F.array_join(text.strip_suffix(F.col("tokens")), " ").alias("joined"))


@query(
    "b9_canonicalize",
    rf"""SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(lower(text), '[\s\p{{Z}}]+', ' ', 'g')),
  '[.?!]+$', ''))) AS digest FROM documents""",
)
def b9(t):
    return t.documents.select("doc_id", F.md5(text.canonicalize(F.col("text"))).alias("digest"))


@query(
    "b10_strip_placeholders",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<[^>]+>', '', 'g'), '\{\{[^}]+\}\}', '', 'g'), '\(([^)]+)\)', '\1', 'g'),
  '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS digest FROM pages""",
)
def b10(t):
    return t.pages.select("page_id", F.md5(text.strip_placeholders(F.col("html"))).alias("digest"))


@query(
    "b11_basename",
    r"SELECT page_id, string_split(translate(url, '\', '/'), '/')[-1] AS file FROM pages",
)
def b11(t):
    return t.pages.select("page_id", text.basename(F.col("url")).alias("file"))


@query(
    "b12_surface_flags",
    rf"""WITH t AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[\s\p{{Z}}]+'), lambda k: k <> '') AS w
  FROM conversations)
SELECT conv_id, turn, coalesce(lower(w[1]), '') AS opener,
  regexp_matches(text, '''[\p{{L}}\p{{N}}_]') AS contraction,
  CAST(len(w) AS INTEGER) AS words, len(w) <= 3 AS short FROM t""",
)
def b12(t):
    c = F.col("text")
    return t.conversations.select(
        "conv_id",
        "turn",
        text.opener(c).alias("opener"),
        text.has_contraction(c).alias("contraction"),
        text.word_count(c).alias("words"),
        text.is_short(c).alias("short"),
    )


@query(
    "b13_ngrams",
    f"""WITH t AS (SELECT doc_id, {DOC_WORDS} AS k FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i+2], ' ')) AS g FROM t)
SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, '|')) AS digest FROM g""",
)
def b13(t):
    d = t.documents.select("doc_id", text.word_tokens(F.col("text")).alias("tok"))
    d = d.select("doc_id", text.ngrams(F.col("tok"), 3).alias("g"))
    return d.select(
        "doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("digest")
    )


EVENT_CLASSES = [("VIEW", 0), ("Click", 1), ("purchase", 2)]


@query(
    "b14_map_label",
    """SELECT CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS INTEGER)
  AS class_id, count(*) AS n FROM events GROUP BY 1""",
)
def b14(t):
    names = literal_table(t.spark, "name string, class_id int", EVENT_CLASSES)
    d = labels.map_label(t.events, "event_type", names)
    return d.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b15_label_index",
    """WITH v AS (SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS idx
  FROM (SELECT DISTINCT event_type FROM events WHERE value > 120))
SELECT e.event_type, CAST(coalesce(v.idx, (SELECT count(*) FROM v)) AS BIGINT) AS idx, count(*) AS n
FROM events e LEFT JOIN v ON v.label = e.event_type GROUP BY 1, 2""",
)
def b15(t):
    from uttermark.operators.vocab import index_labels

    e = t.events
    vocab = index_labels(e.where("value > 120").select(F.col("event_type").alias("label")))
    d = labels.label_index(e.select("event_type"), "event_type", vocab)
    return d.groupBy("event_type", F.col("idx").cast("bigint").alias("idx")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "b16_parse_json_response",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'UNK' ELSE event_type END AS pred_intent,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE 1 END AS n_slots,
  CASE WHEN event_id % 5 = 4 THEN '' ELSE CAST(k AS VARCHAR) END AS slot_value,
  event_id % 5 = 4 AS parse_failed FROM e""",
)
def b16(t):
    """Answers in five shapes: bare, fenced, in prose, after broken braces, and broken."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"intent": "'), F.col("event_type"),
        F.lit('", "slots": [{"slot_type": "k", "value": "'), k, F.lit('"}]}'),
    )
    shape = F.col("event_id") % 5
    raw = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Sure, here it is: "), body, F.lit(" Anything else?")))
        .when(shape == 3, F.concat(F.lit("{not json} and then "), body))
        .otherwise(F.concat(F.lit('{"intent": '), F.col("event_type")))
    )
    d = labels.parse_json_response(t.events.select("event_id", raw.alias("response")), "response")
    return d.select(
        "event_id",
        "pred_intent",
        F.size("pred_slots").alias("n_slots"),
        F.coalesce(F.get("pred_slots", F.lit(0))["value"], F.lit("")).alias("slot_value"),
        "parse_failed",
    )


# A small verb lexicon in the invented language of the conversations.
LEXICON = [
    ("user", ["the", "hath"], ["édre", "wher"]),
    ("assistant", ["ing", "ent"], []),
]

LEXICON_SQL = f"""v AS (SELECT utt_id, role, lower(strip_accents(text)) AS tx FROM (WITH {TURNS_SQL} SELECT * FROM turns)),
lex AS (SELECT utt_id, role,
  CASE role
    WHEN 'user' THEN CASE WHEN contains(tx, 'edre') THEN 'banned=édre' WHEN contains(tx, 'wher') THEN 'banned=wher'
      WHEN contains(tx, 'the') THEN 'the' WHEN contains(tx, 'hath') THEN 'hath' ELSE 'none-listed' END
    WHEN 'assistant' THEN CASE WHEN contains(tx, 'ing') THEN 'ing' WHEN contains(tx, 'ent') THEN 'ent' ELSE 'none-listed' END
    ELSE 'unruled' END AS verb_reason FROM v)"""


def lexicon(t):
    rules = literal_table(
        t.spark, "intent string, expected array<string>, forbidden array<string>", LEXICON
    )
    return labels.validate_lexicon(
        t.turns, "text", "role", rules
    )


@query(
    "b17_validate_lexicon",
    f"""WITH {LEXICON_SQL} SELECT utt_id, verb_reason,
  NOT (verb_reason = 'none-listed' OR verb_reason LIKE 'banned=%') AS verb_ok FROM lex""",
)
def b17(t):
    return lexicon(t).select("utt_id", "verb_reason", "verb_ok")


@query(
    "e29_lexicon_failures",
    f"""WITH {LEXICON_SQL} SELECT 'xx' AS lang, role, verb_reason, count(*) AS n FROM lex
WHERE verb_reason = 'none-listed' OR verb_reason LIKE 'banned=%' GROUP BY 2, 3""",
)
def e29(t):
    return labels.lexicon_failures(lexicon(t).withColumn("lang", F.lit("xx")), "lang", "role")


@query(
    "b18_linear_percentile",
    """SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.9), 6) AS p90
FROM events GROUP BY event_type""",
)
def b18(t):
    d = exact_percentiles(t.events, ["event_type"], "value", {"p25": 25, "p90": 90})
    return d.select("event_type", F.round("p25", 6).alias("p25"), F.round("p90", 6).alias("p90"))


@query(
    "b19_half_even",
    "SELECT l_quantity / 2 AS half, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS rounded, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def b19(t):
    half = F.col("l_quantity") / 2
    d = t.lineitem.select(half.alias("half"), numeric.half_even(half).cast("double").alias("rounded"))
    return d.groupBy("half", "rounded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b20_cosine",
    """WITH x AS (SELECT vec_id, label, unnest(embedding) AS a, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(a) AS b FROM x GROUP BY 1, 2)
SELECT vec_id, round(sum(CAST(a AS DOUBLE) * b) / (sqrt(sum(CAST(a AS DOUBLE) * a)) + 1e-9) / (sqrt(sum(b * b)) + 1e-9), 6) AS cosine
FROM x JOIN c USING (label, d) GROUP BY vec_id""",
)
def b20(t):
    both = t.embeddings.join(similarity.centroids(t.embeddings, ["label"], "embedding"), "label")
    vec = F.col("embedding").cast("array<double>")
    cosine = similarity.cosine(vec, F.col("center"))
    return both.select("vec_id", F.round(cosine, 6).alias("cosine"))
