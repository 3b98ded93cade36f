"""Generation from templates, with value pools taken from the tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from uttermark.functions import tags as B
from uttermark.functions.text import word_tokens
from uttermark.operators import generate
from uttermark.plans.registry import query
from uttermark.session import literal_table, sized

TEMPLATES = [
    ("ship", "send {part} to {region}"),
    ("ship", "ship {part} from {nation.from} to {nation.to}"),
    ("where", "help"),
    ("where", "is {nation.from} near {nation.to} or {region}"),
    ("where", "where is {region}"),
]


def value_pools(t):
    """Part names (two branches by size), nations and regions."""
    part = t.part.select(
        F.lit("part").alias("pool"), (F.length("p_name") > 9).cast("int").alias("branch"), F.col("p_name").alias("value")
    )
    nation = t.nation.select(F.lit("nation").alias("pool"), F.lit(0).alias("branch"), F.lower("n_name").alias("value"))
    region = t.region.select(F.lit("region").alias("pool"), F.lit(0).alias("branch"), F.lower("r_name").alias("value"))
    return generate.value_pool(part.unionByName(nation).unionByName(region))


POOLS_SQL = """pools AS (SELECT pool, branch, value, row_number() OVER (PARTITION BY pool ORDER BY branch, md5(value), value) - 1 AS pos FROM (
  SELECT DISTINCT 'part' AS pool, CASE WHEN length(p_name) > 9 THEN 1 ELSE 0 END AS branch, p_name AS value FROM part
  UNION ALL SELECT DISTINCT 'nation', 0, lower(n_name) FROM nation UNION ALL SELECT DISTINCT 'region', 0, lower(r_name) FROM region)),
ps AS (SELECT pool, count(*) AS n, count(*) FILTER (WHERE branch = 0) AS n0 FROM pools GROUP BY 1)"""


@query("k5_value_pool", f"WITH {POOLS_SQL} SELECT CAST(branch AS INTEGER) AS branch, pool, pos, value FROM pools")
def k5(t):
    return value_pools(t)


def dist(t):
    """Intent weights from the data: customers of two market segments per wanted intent."""
    seg = F.when(F.col("c_mktsegment") < "F", "ship").otherwise("where")
    return t.customer.groupBy(seg.alias("intent")).agg(F.count(F.lit(1)).alias("weight"))


DIST_SQL = """dist AS (SELECT CASE WHEN c_mktsegment < 'F' THEN 'ship' ELSE 'where' END AS intent, count(*) AS weight FROM customer GROUP BY 1)"""


def quota_sql(source, label, total):
    return f"""q0 AS (SELECT {label}, weight, CAST(round_even(weight * ({total}.0::DOUBLE / (SELECT sum(weight) FROM {source})), 0) AS BIGINT) AS q,
  row_number() OVER (ORDER BY weight DESC, {label}) AS r FROM {source}),
quota AS (SELECT {label}, CAST(CASE WHEN r = (SELECT max(r) FROM q0) THEN {total} - coalesce((SELECT sum(q) FROM q0 b WHERE b.r < q0.r), 0) ELSE q END AS BIGINT) AS quota FROM q0)"""


@query("k2_quotas", f"WITH d AS (SELECT lang, count(*) AS weight FROM documents GROUP BY 1), {quota_sql('d', 'lang', 777)} SELECT lang, quota FROM quota")
def k2(t):
    d = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("weight"))
    return generate.quotas(d, "lang", "weight", 777)


def templates(t):
    return literal_table(t.spark, "intent string, template string", TEMPLATES)


TOTAL = 600


def source_attempts(t):
    q = sized(generate.quotas(dist(t), "intent", "weight", TOTAL), "quotas")
    wanted = q.select("intent", (F.col("quota") * 10).alias("n_attempts"))
    made = generate.expand_templates(
        templates(t), value_pools(t), wanted, ["intent"], 42, distinct=("nation",)
    )
    return made, q


def h_sql(label):
    return f"CAST('0x' || substr(md5('42:' || intent || ':' || attempt || ':{label}'), 1, 12) AS BIGINT)"


# The templates of TEMPLATES with their slots by position, as one row per attempt.
ATTEMPTS_SQL = f"""{POOLS_SQL}, {DIST_SQL}, {quota_sql("dist", "intent", TOTAL)},
att AS (SELECT intent, unnest(range(0, quota * 10)) AS attempt FROM quota),
tn AS (SELECT *, CAST({h_sql("t")} % CASE intent WHEN 'ship' THEN 2 ELSE 3 END AS INTEGER) AS t_no,
  {h_sql("0")} AS h0, {h_sql("1")} AS h1, {h_sql("2")} AS h2, {h_sql("0:coin")} AS c0 FROM att),
pk AS (SELECT tn.*, (SELECT n FROM ps WHERE pool = 'part') AS np, (SELECT n0 FROM ps WHERE pool = 'part') AS np0,
  (SELECT n FROM ps WHERE pool = 'nation') AS nn, (SELECT n FROM ps WHERE pool = 'region') AS nr FROM tn),
pos AS (SELECT intent, attempt, t_no,
  CASE WHEN intent = 'ship' THEN CASE WHEN c0 < 140737488355328 THEN h0 % np0 ELSE np0 + h0 % (np - np0) END END AS part,
  CASE WHEN intent = 'ship' AND t_no = 1 THEN h1 % nn WHEN intent = 'where' AND t_no = 1 THEN h0 % nn END AS na,
  CASE WHEN intent = 'ship' AND t_no = 1 THEN h2 % (nn - 1) WHEN intent = 'where' AND t_no = 1 THEN h1 % (nn - 1) END AS nb,
  CASE WHEN intent = 'ship' AND t_no = 0 THEN h1 % nr WHEN intent = 'where' AND t_no = 1 THEN h2 % nr WHEN intent = 'where' AND t_no = 2 THEN h0 % nr END AS reg FROM pk),
filled AS (SELECT pos.intent, attempt, t_no, p.value AS vp, a.value AS va, b.value AS vb, r.value AS vr FROM pos
  LEFT JOIN pools p ON p.pool = 'part' AND p.pos = pos.part LEFT JOIN pools a ON a.pool = 'nation' AND a.pos = na
  LEFT JOIN pools b ON b.pool = 'nation' AND b.pos = nb + CASE WHEN nb >= na THEN 1 ELSE 0 END
  LEFT JOIN pools r ON r.pool = 'region' AND r.pos = reg),
cmd AS (SELECT intent, attempt, CASE WHEN intent = 'ship' AND t_no = 0 THEN 'send ' || vp || ' to ' || vr
  WHEN intent = 'ship' THEN 'ship ' || vp || ' from ' || va || ' to ' || vb
  WHEN t_no = 0 THEN 'help' WHEN t_no = 1 THEN 'is ' || va || ' near ' || vb || ' or ' || vr ELSE 'where is ' || vr END AS command, va, vb FROM filled),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY intent, attempt) AS u FROM cmd) WHERE u = 1),
kept AS (SELECT * FROM (SELECT uq.*, row_number() OVER (PARTITION BY intent ORDER BY attempt) AS rn, quota FROM uq JOIN quota USING (intent)) WHERE rn <= quota)"""


@query("k1_expand_templates", f"WITH {ATTEMPTS_SQL} SELECT intent, attempt, command FROM cmd")
def k1(t):
    made, _ = source_attempts(t)
    return made.select("intent", "attempt", "command")


@query(
    "k3_fill_quota",
    f"""WITH {ATTEMPTS_SQL} SELECT quota.intent, quota, (SELECT count(*) FROM kept k WHERE k.intent = quota.intent) AS n_got,
  quota - (SELECT count(*) FROM kept k WHERE k.intent = quota.intent) AS missing FROM quota""",
)
def k3(t):
    made, q = source_attempts(t)
    kept = generate.fill_quota(made, q, ["intent"], ["command"])
    return generate.shortfall(kept, q, ["intent"])


@query("k3_kept_commands", f"WITH {ATTEMPTS_SQL} SELECT intent, command FROM kept")
def k3_rows(t):
    """The kept utterances, each valid by its own tags (slots placed on its tokens)."""
    made, q = source_attempts(t)
    tok = word_tokens(F.col("command"))
    made = made.withColumn("valid", B.bio_error(tok, B.place_slots(tok, F.col("slots"))) == "")
    return generate.fill_quota(made, q, ["intent"], ["command"]).select("intent", "command")


@query(
    "k4_distinct_picks",
    f"""WITH {ATTEMPTS_SQL} SELECT intent, count(*) AS n, count(*) FILTER (WHERE va = vb) AS n_same, count(DISTINCT va || '>' || vb) AS n_pairs
FROM cmd WHERE va IS NOT NULL GROUP BY 1""",
)
def k4(t):
    """Two places of one utterance always differ."""
    made, _ = source_attempts(t)

    def of(name):
        return F.get(F.filter("slots", lambda s: s["slot_type"] == name), F.lit(0))["value"]

    d = made.select("intent", of("nation.from").alias("a"), of("nation.to").alias("b")).where("a IS NOT NULL")
    per = d.groupBy("intent", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("intent").agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("n_same"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


def carriers(t):
    return t.conversations.select(
        F.concat_ws(":", "conv_id", "turn").alias("utt_id"), F.col("role").alias("intent"), "text"
    )


@query(
    "k7_expand_coverage",
    """WITH m AS (SELECT n_name AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
cp AS (SELECT value, unnest(range(1, CAST(greatest(3, least(round_even(n / (SELECT max(n) FROM m) * 20, 0), 20)) AS BIGINT) + 1)) AS copy FROM m),
ca AS (SELECT conv_id || ':' || turn AS utt_id, role AS intent FROM conversations),
ro AS (SELECT list(DISTINCT role ORDER BY role) AS r FROM conversations),
nb AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY md5('carrier-42:' || utt_id), utt_id) AS rn, count(*) OVER (PARTITION BY intent) AS size FROM ca),
ch AS (SELECT value, copy, (SELECT r FROM ro)[1 + CAST('0x' || substr(md5('42:' || value || ':' || copy || ':intent'), 1, 12) AS BIGINT) % (SELECT len(r) FROM ro)] AS intent,
  CAST('0x' || substr(md5('42:' || value || ':' || copy || ':row'), 1, 12) AS BIGINT) AS h FROM cp)
SELECT ch.value, CAST(ch.copy AS INTEGER) AS copy, ch.intent, nb.utt_id FROM ch JOIN nb ON nb.intent = ch.intent AND nb.rn = ch.h % nb.size + 1""",
)
def k7(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    missing = t.nation.join(n, "n_nationkey").select(F.col("n_name").alias("value"), "n")
    d = generate.expand_coverage(carriers(t), missing, ["utt_id"])
    return d.select("value", "copy", "intent", "utt_id")


FAMILIES = [
    ("indirect", True, "ship", "could you send {part} to {region}"),
    ("indirect", True, "where", "i wonder where {region} is"),
    ("indirect", False, "ship", "could someone send {part}"),
    ("first_person", True, "ship", "i want {part} in {region}"),
    ("first_person", True, "where", "i am lost in {nation}"),
    ("first_person", False, "ship", "i need {part} now"),
]


def families(t):
    return literal_table(
        t.spark, "family string, with_slot boolean, intent string, template string", FAMILIES
    )


def _share_sql(name, source, group, key, size, quota):
    """Equal shares in closed form: full units first, then a level and one more for the first."""
    return f"""{name}_a AS (SELECT *, least({size}, {quota}) AS sz, row_number() OVER (PARTITION BY {group} ORDER BY least({size}, {quota}), {key}) AS no,
  count(*) OVER (PARTITION BY {group}) AS cnt FROM {source}),
{name}_b AS (SELECT *, coalesce(sum(sz) OVER (PARTITION BY {group} ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN below + sz * (cnt - no + 1) > {quota} THEN no END) OVER (PARTITION BY {group}) AS k FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN no = k THEN below END) OVER (PARTITION BY {group}) AS bk FROM {name}_c),
{name} AS (SELECT * EXCLUDE (sz, no, cnt, below, k, bk), CAST(CASE WHEN k IS NULL OR no < k THEN sz
  ELSE ({quota} - bk) // (cnt - k + 1) + CASE WHEN no - k < ({quota} - bk) % (cnt - k + 1) THEN 1 ELSE 0 END END AS BIGINT) AS {name} FROM {name}_d)"""


def _draws_sql(rows, quota):
    """Distinct draws for templates of at most two slots: ``made(group..., intent, command)``.

    ``rows``: (g1, with_slot, intent, template, text to sort by); ``quota``: a table of g1,
    with_slot, quota.
    """
    values = []
    for g1, with_slot, intent, template, place in rows:
        slots = [f"'{x}'" for x in re.findall(r"\{(.*?)\}", template)]
        s0, s1 = (slots + ["NULL", "NULL"])[:2]
        values.append(f"('{g1}', {with_slot}, '{intent}', '{template}', '{place}', {s0}, {s1})")

    def h(*parts):
        text = " || ':' || ".join(["'42'", "g1", "CASE WHEN with_slot THEN 'true' ELSE 'false' END", "t_no", "v_no", *parts])
        return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"

    mirror = f"((({h('r')} % size) - a + size) % size)"
    bit = h("r", f"greatest(a, {mirror})") + " % 2"
    return f"""tpl(g1, with_slot, intent, template, place, s0, s1) AS (VALUES {", ".join(values)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g1, with_slot ORDER BY place) - 1 AS t_no FROM tpl),
br AS (SELECT pool, 0 AS b, 0 AS st, n0 AS n FROM ps WHERE n0 > 0 AND n0 < n UNION ALL SELECT pool, 1, n0, n - n0 FROM ps WHERE n0 > 0 AND n0 < n
  UNION ALL SELECT pool, 0, 0, n FROM ps WHERE NOT (n0 > 0 AND n0 < n)),
units AS (SELECT t.*, row_number() OVER (PARTITION BY g1, with_slot, t_no ORDER BY x.b, y.b) - 1 AS v_no, x.st AS st0, x.n AS n_0, coalesce(y.st, 0) AS st1,
  coalesce(y.n, 1) AS n_1, x.n * coalesce(y.n, 1) AS size FROM numbered t JOIN br x ON x.pool = s0 LEFT JOIN br y ON y.pool = s1),
whole AS (SELECT g1, with_slot, t_no, sum(size) AS t_size, any_value(quota) AS quota FROM units JOIN {quota} USING (g1, with_slot) GROUP BY 1, 2, 3),
{_share_sql("t_share", "whole", "g1, with_slot", "t_no", "t_size", "quota")},
parts AS (SELECT units.*, t_share FROM units JOIN t_share USING (g1, with_slot, t_no)),
{_share_sql("n_draws", "parts", "g1, with_slot, t_no", "v_no", "size", "t_share")},
drawn AS (SELECT *, unnest(range(0, n_draws)) AS draw FROM n_draws),
perm AS (SELECT *, list_reduce(list_prepend(draw, range(1, 25)), lambda a, r: CASE WHEN {bit} = 1 THEN {mirror} ELSE a END) AS x FROM drawn),
made AS (SELECT p.g1, p.with_slot, intent, replace(replace(template, '{{' || s0 || '}}', a.value), coalesce('{{' || s1 || '}}', '-'), coalesce(b.value, '-')) AS command
  FROM perm p JOIN pools a ON a.pool = s0 AND a.pos = st0 + x % n_0 LEFT JOIN pools b ON b.pool = s1 AND b.pos = st1 + (x // n_0) % n_1)"""


K8_QUOTA = """q8(g1, with_slot, quota) AS (VALUES ('indirect', true, 45), ('indirect', false, 15), ('first_person', true, 45), ('first_person', false, 15))"""
K8_ROWS = [(f, w, i, x, f"{i}\u0001{x}") for f, w, i, x in FAMILIES]


@query(
    "k8_family_ablation",
    f"""WITH {POOLS_SQL}, {K8_QUOTA}, {_draws_sql(K8_ROWS, "q8")}
SELECT g1 AS family, with_slot, intent, command FROM made""",
)
def k8(t):
    d, _ = generate.family_ablation(families(t), value_pools(t), 60)
    return d.select("family", "with_slot", "intent", "command")


@query(
    "k8_family_counts",
    """WITH s AS (SELECT (SELECT count(DISTINCT p_name) FROM part) AS p, (SELECT count(DISTINCT lower(r_name)) FROM region) AS r,
  (SELECT count(DISTINCT lower(n_name)) FROM nation) AS c),
possible(family, with_slot, quota, n) AS (SELECT 'indirect', true, 45, p * r + r FROM s UNION ALL SELECT 'indirect', false, 15, p FROM s
  UNION ALL SELECT 'first_person', true, 45, p * r + c FROM s UNION ALL SELECT 'first_person', false, 15, p FROM s)
SELECT family, with_slot, CAST(least(quota, n) AS BIGINT) AS n, CAST(least(quota, n) AS BIGINT) AS n_unique FROM possible""",
)
def k8_counts(t):
    """Both families fill their budget of 60: 45 with the slot, 15 without, no repeats."""
    d, _ = generate.family_ablation(families(t), value_pools(t), 60)
    per = d.groupBy("family", "with_slot", "command", "intent").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("family", "with_slot").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_unique"))


AUGMENT = [(i, w, x) for _, w, i, x in FAMILIES] + [("where", False, "where am i near {part}")]


def augmented(t):
    tpl = literal_table(t.spark, "intent string, with_slot boolean, template string", AUGMENT)
    counts = dist(t).select("intent", F.col("weight").alias("target"))
    return generate.augment(tpl, value_pools(t), counts)


K9_SQL = f"""{POOLS_SQL}, {DIST_SQL}, q9 AS (SELECT intent AS g1, s AS with_slot,
  CAST(CASE WHEN s THEN weight - round_even(weight * 0.25::DOUBLE, 0) ELSE round_even(weight * 0.25::DOUBLE, 0) END AS BIGINT) AS quota FROM dist, (VALUES (true), (false)) v(s)),
{_draws_sql([(i, w, i, x, x) for i, w, x in AUGMENT], "q9")}"""


@query("k9_augment", f"WITH {K9_SQL} SELECT g1 AS intent, with_slot, command FROM made")
def k9(t):
    made, _ = augmented(t)
    return made.select("intent", "with_slot", "command")


@query(
    "k9_shortfall",
    f"""WITH {K9_SQL} SELECT g1 AS intent, with_slot, quota, count(command) AS n_got, quota - count(command) AS missing
FROM q9 LEFT JOIN made USING (g1, with_slot) GROUP BY 1, 2, 3""",
)
def k9_missing(t):
    """Rows wanted, got and missing: small value pools cannot fill every quota."""
    return augmented(t)[1]


@query(
    "k10_translation_table",
    """SELECT p_type AS slot_type, CAST(p_size AS VARCHAR) AS value, CAST(p_size AS VARCHAR) AS translated FROM part GROUP BY 1, 2
UNION ALL SELECT p_type, p_name, 'le ' || min(p_name) FROM part GROUP BY 1, 2
UNION ALL SELECT p_type, upper(p_name), 'le ' || min(p_name) FROM part GROUP BY 1, 2""",
)
def k10(t):
    """Main values, their capitals as synonyms, and digits."""
    names = t.part.select(F.col("p_type").alias("slot_type"), F.col("p_name").alias("value")).distinct()
    none = F.lit(None).cast("string")
    values = names.withColumn("canonical", none).unionByName(
        names.select("slot_type", F.upper("value").alias("value"), F.col("value").alias("canonical"))
    )
    sizes = t.part.select(F.col("p_type").alias("slot_type"), F.col("p_size").cast("string").alias("value")).distinct()
    values = values.unionByName(sizes.withColumn("canonical", none))
    dictionary = names.select("slot_type", "value", F.concat(F.lit("le "), F.col("value")).alias("translated"))
    return generate.translation_table(values, dictionary)
