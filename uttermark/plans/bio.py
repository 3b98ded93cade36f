"""BIO and slot algebra over conversation turns."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from uttermark.operators import bio
from uttermark.plans.registry import SQL_WORD, TAGGED_SQL, TURNS_SQL, query, spans_sql
from uttermark.plans.text import contracted_sql


@query(
    "f1_bio_spans",
    f"""WITH {TAGGED_SQL}, {spans_sql("gold", "gs")}
SELECT utt_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", label FROM gs""",
)
def f1(t):
    return bio.bio_spans(t.tagged, ["utt_id"], "gold")


def joined(df, *cols):
    return df.select("utt_id", *[F.array_join(c, " ").alias(c) for c in cols])


def capitals(c):
    """ASCII capitals only: engines differ on the capital of some letters."""
    return F.translate(c, ascii_lowercase, ascii_uppercase)


def slotted(t):
    """Turns with slots cut from their own tokens: two overlap, one is absent, one is in
    capitals; three have a translation and the source value is another word."""
    k = F.col("tokens")

    def part(start, n):
        return F.array_join(F.slice(k, start, n), " ")

    def slot(name, value):
        return F.struct(F.lit(name).alias("slot_type"), value.alias("value"))

    def trans(name, original, translated):
        return F.struct(
            F.lit(name).alias("slot_type"), original.alias("original"), translated.alias("translated")
        )

    return t.turns.withColumn(
        "slots",
        F.array(
            slot("alpha", part(2, 2)), slot("beta", part(3, 1)), slot("gamma", F.lit("absent word")),
            slot("delta", capitals(part(5, 2))), slot("eps", part(1, 1)),
        ),
    ).withColumn(
        "sources",
        F.array(
            slot("alpha", F.lit("Source One")), slot("beta", part(3, 1)), slot("gamma", F.lit("None")),
            slot("delta", F.lit("source two")), slot("eps", F.lit("source three")),
        ),
    ).withColumn(
        "translations",
        F.array(
            trans("x", F.lit("source one"), part(2, 2)),
            trans("y", F.lit(" SOURCE two "), capitals(part(5, 2))),
            trans("z", F.lit("source three"), F.substring(part(7, 1), 1, 4)),
        ),
    ).withColumn("lang", F.when(F.col("role") == "user", "en").otherwise("fr")).withColumn(
        "is_char", F.col("role") == "system"
    )


SLOTS_SQL = f"""{TURNS_SQL}, k AS (SELECT *, CASE WHEN role = 'user' THEN 'en' ELSE 'fr' END AS lang, role = 'system' AS is_char,
  array_to_string(tokens[2:3], ' ') AS va, coalesce(tokens[3], '') AS vb, translate(array_to_string(tokens[5:6], ' '), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS vd,
  coalesce(tokens[1], '') AS ve, substr(coalesce(tokens[7], ''), 1, 4) AS vz FROM turns)"""


def find_sql(tokens, value, free=None):
    """0-based first start of a token list in another (optionally only where tags are O)."""
    taken = (
        f" AND len(list_filter({free}[i + 1:i + len({value})], lambda x: x <> 'O')) = 0" if free else ""
    )
    return (
        f"list_filter(range(0, greatest(len({tokens}) - len({value}) + 1, 0)), "
        f"lambda i: len({value}) > 0 AND {tokens}[i + 1:i + len({value})] = {value}{taken})[1]"
    )


def words_sql(expr):
    return f"regexp_extract_all(lower({expr}), {SQL_WORD})"


def slot_list(pairs, tokenise):
    """SQL list of [type, token...] lists; an empty value leaves only the type."""
    return "[" + ", ".join(f"list_concat(['{n}'], {tokenise(v)})" for n, v in pairs) + "]"


def reduce_sql(slots, tokens, step):
    """Fold slots over tags; ``step`` gives a [start, length] list or NULL, bound once."""
    blank = f"list_transform({tokens}, lambda x: 'O')"
    return f"""list_reduce({slots}, lambda acc, s: list_transform([{step}], lambda p: CASE WHEN p IS NULL THEN acc ELSE
      list_concat(acc[1:p[1]], ['B-' || s[1]], list_transform(range(1, p[2]), lambda j: 'I-' || s[1]), acc[p[1] + p[2] + 1:]) END)[1], {blank})"""


def place_sql(start, length):
    return f"CASE WHEN {start} IS NOT NULL THEN [{start}, {length}] END"


L1_SLOTS = [("alpha", "va"), ("beta", "vb"), ("gamma", "'absent word'"), ("delta", "vd"), ("eps", "ve")]


@query(
    "l1_slots_to_bio",
    f"""WITH {SLOTS_SQL}, s AS (SELECT utt_id, tokens, {slot_list(L1_SLOTS, words_sql)} AS slots FROM k)
SELECT utt_id, coalesce(array_to_string({reduce_sql("slots", "tokens", place_sql(find_sql("tokens", "s[2:]", "acc"), "len(s) - 1"))}, ' '), '') AS bio FROM s""",
)
def l1(t):
    return joined(bio.slots_to_bio(slotted(t), "tokens", "slots"), "bio")


SPACED = r"list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda k: k <> '')"


@query(
    "l2_source_bio",
    f"""WITH {SLOTS_SQL}, w AS (SELECT utt_id, {SPACED} AS tokens, unnest([1, 2, 3, 4, 5]) AS no,
  unnest([string_split(va, ' '), string_split(vb, ' '), ['absent', 'word'], string_split(lower(vd), ' '), string_split(ve, ' ')]) AS v FROM k),
c AS (SELECT utt_id, no, len(v) AS n, {find_sql("tokens", "v")} AS st FROM w WHERE v[1] <> ''),
o AS (SELECT utt_id, list([CAST(no AS VARCHAR), CAST(st AS VARCHAR), CAST(n AS VARCHAR)] ORDER BY st, no) AS slots FROM c WHERE st IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT utt_id, tokens FROM w),
b AS (SELECT d.utt_id, tokens, coalesce(slots, []) AS slots FROM d LEFT JOIN o USING (utt_id))
SELECT utt_id, array_to_string(tokens, ' ') AS tokens, coalesce(array_to_string(list_reduce(slots, lambda acc, s:
  CASE WHEN len(list_filter(acc[CAST(s[2] AS INT) + 1:CAST(s[2] AS INT) + CAST(s[3] AS INT)], lambda x: x <> 'O')) > 0 THEN acc ELSE
    list_transform(range(0, len(tokens)), lambda j: CASE WHEN j = CAST(s[2] AS INT) THEN 'B-' || ['alpha', 'beta', 'gamma', 'delta', 'eps'][CAST(s[1] AS INT)]
      WHEN j > CAST(s[2] AS INT) AND j < CAST(s[2] AS INT) + CAST(s[3] AS INT) THEN 'I-' || ['alpha', 'beta', 'gamma', 'delta', 'eps'][CAST(s[1] AS INT)]
      ELSE acc[j + 1] END) END, list_transform(tokens, lambda x: 'O')), ' '), '') AS bio FROM b""",
)
def l2(t):
    return joined(bio.source_bio(slotted(t), "text", "slots"), "tokens", "bio")


# Projection: [type, translated value, source value] as token lists side by side.
def _projection_sql(word_place, char_place):
    """Both tokenisations; the value lists of a slot are cut by a marker token."""
    pairs = [("alpha", "va", "'Source One'"), ("beta", "vb", "vb"), ("delta", "vd", "'source two'"), ("eps", "vz", "'source three'")]

    def slots(tok):
        return "[" + ", ".join(
            f"list_concat(['{n}'], {tok(f'CASE WHEN {a} = {chr(39) * 2} THEN {b} ELSE {a} END')}, ['|'], {tok(b)})" for n, a, b in pairs
        ) + "]"

    def chars(e):
        return rf"regexp_extract_all({e}, '[^\p{{Z}}\s]')"

    first, second = "s[2:list_position(s, '|') - 1]", "s[list_position(s, '|') + 1:]"

    def step(place):
        return f"""list_filter([{place(first)}, {place(second)}], lambda p: p IS NOT NULL)[1]"""

    def guarded(place):
        free = "len(list_filter(acc[p[1] + 1:p[1] + p[2]], lambda x: x <> 'O')) = 0"
        return f"list_transform([{step(place)}], lambda p: CASE WHEN {free} THEN p END)[1]"

    return f"""WITH {SLOTS_SQL}, x AS (SELECT utt_id, is_char, CASE WHEN is_char THEN {chars("text")} ELSE tokens END AS tokens,
  CASE WHEN is_char THEN {slots(chars)} ELSE {slots(words_sql)} END AS slots FROM k), y AS (SELECT *, list_transform(tokens, lambda x: lower(x)) AS low FROM x)
SELECT utt_id, array_to_string(tokens, ' ') AS tokens, coalesce(array_to_string(CASE WHEN is_char THEN {reduce_sql("slots", "tokens", guarded(char_place))}
  ELSE {reduce_sql("slots", "tokens", guarded(word_place))} END, ' '), '') AS bio FROM y"""


def _word_place(v):
    exact = place_sql(find_sql("tokens", v), f"len({v})")
    part = f"list_filter(range(0, len(tokens)), lambda i: contains(tokens[i + 1], ({v})[1]))[1]"
    return f"coalesce({exact}, {place_sql(part, '1')})"


def _char_place(v):
    low = f"list_transform({v}, lambda x: lower(x))"
    return f"coalesce({place_sql(find_sql('tokens', v), f'len({v})')}, {place_sql(find_sql('low', low), f'len({v})')})"


@query("l3_project_slots", _projection_sql(_word_place, _char_place))
def l3(t):
    d = bio.project_slots(slotted(t), "text", "sources", "translations", F.col("is_char"))
    return joined(d, "tokens", "bio")


EMPTY = "''"
FRENCH = "translate(replace(text, ' and ', ' l' || chr(39) || 'and '), 'eo', 'éô')"


def fold_sql(tokens):
    return f"list_transform({tokens}, lambda x: lower(strip_accents(x)))"


def _folded_sql():
    """Slots as [type, translated..., '|', source...], all folded."""
    pairs = [
        ("alpha", "va", "'Source One'"),
        ("beta", "vb", "vb"),
        ("delta", "vd", "'source two'"),
        ("eps", "vz", "'source three'"),
    ]
    slots = "[" + ", ".join(
        f"list_concat(['{n}'], {fold_sql(words_sql(f'coalesce(nullif({a}, {EMPTY}), {b})'))}, ['|'], {fold_sql(words_sql(b))})"
        for n, a, b in pairs
    ) + "]"

    def place(v):
        fused = (
            f"list_filter(range(0, len(tokens)), lambda i: len({v}) = 1 AND contains(tokens[i + 1], chr(39)) "
            f"AND list_contains(string_split(tokens[i + 1], chr(39)), ({v})[1]))[1]"
        )
        return f"coalesce({place_sql(find_sql('tokens', v), f'len({v})')}, {place_sql(fused, '1')})"

    first, second = "s[2:list_position(s, '|') - 1]", "s[list_position(s, '|') + 1:]"
    best = f"list_filter([{place(first)}, {place(second)}], lambda p: p IS NOT NULL)[1]"
    free = "len(list_filter(acc[p[1] + 1:p[1] + p[2]], lambda x: x <> 'O')) = 0"
    step = f"list_transform([{best}], lambda p: CASE WHEN {free} THEN p END)[1]"
    return f"""WITH {SLOTS_SQL}, x AS (SELECT utt_id, {words_sql(FRENCH)} AS shown, {slots} AS slots FROM k),
y AS (SELECT *, {fold_sql("shown")} AS tokens FROM x)
SELECT utt_id, array_to_string(shown, ' ') AS tokens, coalesce(array_to_string({reduce_sql("slots", "tokens", step)}, ' '), '') AS bio FROM y"""


@query("l4_project_slots_folded", _folded_sql())
def l4(t):
    """The turns in French spelling: accents and elisions that folding has to undo."""
    elided = F.replace(F.col("text"), F.lit(" and "), F.lit(" l'and "))
    d = slotted(t).withColumn("text", F.translate(elided, "eo", "éô"))
    return joined(bio.project_slots_folded(d, "text", "sources", "translations"), "tokens", "bio")


def _reproject_sql():
    def spaced(e):
        x = f"CASE WHEN lang = 'en' THEN {contracted_sql(e)} ELSE lower({e}) END"
        x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}_])\.', '\1', 'g')"
        x = rf"regexp_replace({x}, '[\s\p{{Z}}]+', ' ', 'g')"
        return f"list_filter(string_split({x}, ' '), lambda k: k <> '')"

    def chars(e):
        return rf"regexp_extract_all({e}, '[^\p{{Z}}\s]')"

    def slots(tok):
        return slot_list([("x", "va"), ("y", "vd"), ("z", "vz")], tok)

    def bare(x):
        return rf"list_transform({x}, lambda k: regexp_replace(k, chr(39) || '[\p{{L}}\p{{N}}_]*$', ''))"

    def either(other_tokens, other_value):
        plain = place_sql(find_sql("tokens", "s[2:]", "acc"), "len(s) - 1")
        return f"coalesce({plain}, {place_sql(find_sql(other_tokens, other_value, 'acc'), 'len(s) - 1')})"

    words = either("bare", bare("s[2:]"))
    letters = either("low", "list_transform(s[2:], lambda k: lower(k))")
    return f"""WITH {SLOTS_SQL}, x AS (SELECT utt_id, is_char, CASE WHEN is_char THEN {chars("text")} ELSE {spaced("text")} END AS tokens,
  CASE WHEN is_char THEN {slots(chars)} ELSE {slots(spaced)} END AS slots FROM k),
y AS (SELECT *, {bare("tokens")} AS bare, list_transform(tokens, lambda k: lower(k)) AS low FROM x)
SELECT utt_id, array_to_string(tokens, ' ') AS tokens, coalesce(array_to_string(CASE WHEN is_char THEN {reduce_sql("slots", "tokens", letters)}
  ELSE {reduce_sql("slots", "tokens", words)} END, ' '), '') AS bio FROM y"""


@query("l5_reproject", _reproject_sql())
def l5(t):
    d = bio.reproject(slotted(t), "text", "translations", "lang", F.col("is_char"))
    return joined(d, "tokens", "bio")


CHUNKS_SQL = f"""{TAGGED_SQL}, u AS (SELECT utt_id, unnest(tokens) AS tok, unnest(gold) AS tag, generate_subscripts(gold, 1) - 1 AS pos, len(gold) AS n FROM tagged),
v AS (SELECT *, CASE WHEN pos = 0 OR tag LIKE 'B-%' OR (tag = 'O' AND lag(tag) OVER (PARTITION BY utt_id ORDER BY pos) <> 'O') THEN 1 ELSE 0 END AS st FROM u),
w AS (SELECT *, sum(st) OVER (PARTITION BY utt_id ORDER BY pos) AS cid FROM v),
x AS (SELECT utt_id, cid, min(pos) AS s, max(pos) + 1 AS e, max(n) AS n, string_agg(tok, ' ' ORDER BY pos) AS words,
  substr(arg_min(tag, pos) FILTER (WHERE tag <> 'O'), 3) AS slot, list(tok ORDER BY pos) AS toks FROM w GROUP BY 1, 2),
chunks AS (SELECT *, CASE WHEN slot IS NULL THEN CASE WHEN s > 0 THEN ' ' ELSE '' END || words || CASE WHEN e < n THEN ' ' ELSE '' END ELSE words END AS text FROM x)"""


def chunked(t):
    return bio.bio_to_chunks(t.tagged, "tokens", "gold")


def show_chunks(df):
    shown = F.transform(
        "chunks", lambda c: F.concat(F.coalesce(c["slot_name"], F.lit("-")), F.lit(":"), c["text"])
    )
    return F.array_join(shown, "|")


@query(
    "l7_bio_to_chunks",
    f"""WITH {CHUNKS_SQL} SELECT t.utt_id, coalesce(string_agg(coalesce(slot, '-') || ':' || c.text, '|' ORDER BY cid), '') AS chunks
FROM tagged t LEFT JOIN chunks c ON c.utt_id = t.utt_id GROUP BY 1""",
)
def l7(t):
    d = chunked(t)
    return d.select("utt_id", show_chunks(d).alias("chunks"))


@query(
    "l6_chunks_to_bio",
    f"""WITH {CHUNKS_SQL}, y AS (SELECT utt_id, cid, list_transform(toks, lambda k, i: CASE WHEN slot IS NULL THEN 'O' WHEN i = 1 THEN 'B-' || slot ELSE 'I-' || slot END) AS tg, toks, text FROM chunks)
SELECT t.utt_id, coalesce(string_agg(array_to_string(toks, ' '), ' ' ORDER BY cid), '') AS tokens, coalesce(string_agg(array_to_string(tg, ' '), ' ' ORDER BY cid), '') AS bio,
  trim(coalesce(string_agg(y.text, '' ORDER BY cid), '')) AS text FROM tagged t LEFT JOIN y ON y.utt_id = t.utt_id GROUP BY 1""",
)
def l6(t):
    d = bio.chunks_to_bio(chunked(t).select("utt_id", "chunks"), "chunks")
    return d.select(
        "utt_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("bio", " ").alias("bio"), "text"
    )


MERGED_SQL = """m AS (SELECT utt_id, cid, text, CASE WHEN {cond} THEN NULL ELSE slot END AS slot FROM {src}),
n AS (SELECT *, CASE WHEN slot IS NULL AND lag(slot) OVER (PARTITION BY utt_id ORDER BY cid) IS NULL AND row_number() OVER (PARTITION BY utt_id ORDER BY cid) > 1 THEN 0 ELSE 1 END AS st FROM m),
o AS (SELECT *, sum(st) OVER (PARTITION BY utt_id ORDER BY cid) AS g FROM n),
p AS (SELECT utt_id, g, min(slot) AS slot, string_agg(text, '' ORDER BY cid) AS text FROM o GROUP BY 1, 2),
q AS (SELECT utt_id, string_agg(coalesce(slot, '-') || ':' || text, '|' ORDER BY g) AS chunks FROM p GROUP BY 1)"""


@query(
    "f6_merge_text_chunks",
    f"WITH {CHUNKS_SQL}, {MERGED_SQL.format(cond=chr(39) + 'mid' + chr(39) + ' = slot', src='chunks')} "
    "SELECT t.utt_id, coalesce(chunks, '') AS chunks FROM tagged t LEFT JOIN q USING (utt_id)",
)
def f6(t):
    """All 'mid' chunks taken as plain text, then joined with their plain neighbours."""
    plain = F.transform(
        "chunks",
        lambda c: F.struct(
            c["text"].alias("text"), F.when(c["slot_name"] == "mid", None).otherwise(c["slot_name"]).alias("slot_name")
        ),
    )
    d = chunked(t).withColumn("chunks", plain).withColumn("chunks", bio.merge_text_chunks(F.col("chunks")))
    return d.select("utt_id", show_chunks(d).alias("chunks"))


MISLABEL = "thand"


@query(
    "k6_demote_slot",
    f"""WITH {CHUNKS_SQL}, bad AS (SELECT utt_id FROM chunks WHERE slot = 'mid' GROUP BY 1 HAVING lower(trim(arg_min(text, cid))) = '{MISLABEL}'),
{MERGED_SQL.format(cond="slot = 'mid'", src="(SELECT * FROM chunks WHERE utt_id IN (SELECT utt_id FROM bad)) z")},
r AS (SELECT utt_id, string_agg(coalesce(slot, '-') || ':' || text, '|' ORDER BY cid) AS chunks FROM chunks GROUP BY 1)
SELECT t.utt_id, bad.utt_id IS NOT NULL AS demoted, coalesce(q.chunks, r.chunks, '') AS chunks
FROM tagged t LEFT JOIN bad USING (utt_id) LEFT JOIN q USING (utt_id) LEFT JOIN r USING (utt_id)""",
)
def k6(t):
    d = bio.demote_slot(chunked(t), "chunks", "mid", MISLABEL)
    return d.select("utt_id", "demoted", show_chunks(d).alias("chunks"))


@query(
    "l8_keep_source_tags",
    f"""WITH {TAGGED_SQL} SELECT utt_id, array_to_string(CASE WHEN role = 'user' AND len(gold) > 0 THEN gold ELSE pred END, ' ') AS bio FROM tagged""",
)
def l8(t):
    d = bio.keep_source_tags(t.tagged, "role", "gold", "pred", "user")
    return joined(d, "bio")
