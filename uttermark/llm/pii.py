"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans.  Wider patterns give candidates; per candidate five labelers
(form, gazetteer, context words, borders, shape) vote for, against or not at all.  The counts of
vote patterns, a table of bounded size, are all that is gathered: expectation-maximisation turns
them into the labelers' reliabilities and a probability per pattern, and a logistic classifier over
span features is fitted to these.  Candidates it is sure of are added to the base spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.llm.common import fresh

KINDS = ("email", "ip", "card", "phone")

# The strict patterns.  Possessive and anchored where that cannot change a match, so
# that long runs of letters or digits take linear time and no stack.
LOCAL = "[A-Za-z0-9._%+-]"
START = rf"(?:(?<!{LOCAL})|\G)"
STRICT = {
    "email": rf"{START}{LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns, for candidates.
WIDE = {
    "email": rf"{START}{LOCAL}++(?:@| ?[\[(](?:at|AT)[\])] ?)[A-Za-z0-9-]++"
    r"(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]?[0-9]{2,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
}
# Texts without this have no match of the kind.
NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9][.\[]", "card": "[0-9]", "phone": "[0-9]"}

# Gazetteers and context words: own lists.
ENDINGS = "com org net edu gov io info biz eu de fr es it uk us ca ch at nl be pl pt ru jp cn in br au".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|62|35)"
COUNTRIES = r"^(?:\+|00)(?:1|7|20|27|3[0-469]|4[0135-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|35[0-9])"
RESERVED = r"^(?:0|127|255)\."
CUES = {
    "email": "mail|contact|write|reach|schreib|kontakt|courriel|correo|escrib",
    "ip": r"\bip\b|address|host|server|login|adresse|direcci",
    "card": "card|visa|master|credit|carte|karte|tarjeta|payment",
    "phone": r"\btel|phone|call|mobile|fax|ruf|appel|llam|móvil|handy",
}
COUNTER = r"isbn|issn|version|order|invoice|serial|\bno\.|page|figure|section|chapter|\bid\b"

LABELERS = 5
FEATURES = 9  # of the span classifier, the constant included
EM_ROUNDS = 25
FIT_ROUNDS = 200
SURE = 0.95


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, not wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_starts(sizes: Column) -> Column:
    """Exclusive running sums of an array, in blocks, so that long arrays stay cheap."""
    zero = F.lit(0)
    add = lambda a, x: a + x
    block = 64
    n = F.size(sizes)
    blocks = F.transform(
        F.sequence(zero, F.floor((F.greatest(n, F.lit(1)) - 1) / block).cast("int")),
        lambda b: F.aggregate(F.slice(sizes, b * block + 1, F.lit(block)), zero, add),
    )


    def start(sums):
        return F.transform(
            sizes,
            lambda _, i: F.aggregate(F.slice(sums, F.lit(1), F.floor(i / block).cast("int")), zero, add)
            + F.aggregate(F.slice(sizes, F.floor(i / block).cast("int") * block + 1, i % block), zero, add),
        )

    return let(blocks, start)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits (short ones only) passes the check sum."""
    n = F.length(number)

    def step(total, k):
        d = F.substr(number, n - k + 1, F.lit(1)).try_cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.coalesce(F.when(k % 2 == 0, twice).otherwise(d), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check that a strict match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(
            F.split(value, r"\."),
            lambda p: (F.length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255),
        )
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return n.between(10, 15)


def located(df: DataFrame, patterns: dict[str, str], prefix: str, text: str) -> DataFrame:
    """Append per kind an array of matches: start and end (code points), value, what is around."""
    src = F.coalesce(F.col(text), F.lit(""))
    found = {k: f"{prefix}found_{k}" for k in patterns}
    pieces = {k: f"{prefix}pieces_{k}" for k in patterns}
    starts = {k: f"{prefix}starts_{k}" for k in patterns}
    none = F.array().cast("array<string>")
    df = df.withColumns(
        {
            found[k]: F.when(src.rlike(NEEDS[k]), F.regexp_extract_all(src, F.lit(p), F.lit(0))).otherwise(none)
            for k, p in patterns.items()
        }
    )
    df = df.withColumns(
        {
            pieces[k]: F.when(F.size(found[k]) > 0, F.split(src, p, -1)).otherwise(none)
            for k, p in patterns.items()
        }
    )

    def lengths(k):
        return F.transform(F.col(found[k]), lambda h, i: F.length(h) + F.length(F.get(F.col(pieces[k]), i)))

    df = df.withColumns({starts[k]: let(lengths(k), running_starts) for k in patterns})

    def one(k):
        def at(h, i):
            start = F.get(F.col(starts[k]), i) + F.length(F.get(F.col(pieces[k]), i))
            return F.struct(
                F.lit(k).alias("kind"),
                start.alias("start"),
                (start + F.length(h)).alias("end"),
                h.alias("value"),
                F.right(F.get(F.col(pieces[k]), i), F.lit(24)).alias("before"),
                F.left(F.get(F.col(pieces[k]), i + 1), F.lit(1)).alias("after"),
            )

        return F.transform(F.col(found[k]), at)

    df = df.withColumns({f"{prefix}{k}": one(k) for k in patterns})
    return df.drop(*found.values(), *pieces.values(), *starts.values())


def base_spans(df: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """Append ``<prefix><kind>``: the strict matches of each kind that pass their check."""
    df = located(df, STRICT, prefix, text)
    checked = lambda k: F.filter(F.col(prefix + k), lambda s: passes(k, s["value"]))
    return df.withColumns({prefix + k: checked(k) for k in KINDS})


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def votes(kind: str, s: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 personal, -1 not, 0 no opinion."""
    v, before, after = s["value"], F.lower(s["before"]), s["after"]
    n = F.length(digits(v))
    never = F.lit(False)
    glued = F.right(before, F.lit(1)).rlike(r"[\p{L}0-9_]") | after.rlike(r"[\p{L}0-9_]")
    loose = (before == "") | F.right(before, F.lit(1)).rlike(r"[\s(\[\"':<|]")
    form = {
        "email": _vote(v.rlike(r"@.*\.[A-Za-z]{2,}$"), ~v.rlike(r"(?i)[@)\]].*(\.|dot[)\]] ?)[a-z]{2,}$")),
        "ip": _vote(~v.contains("["), ~passes("ip", F.translate(v, "[]", ""))),
        "card": _vote(passes("card", v), ~passes("card", v)),
        "phone": _vote(v.rlike(r"^(?:\+|00)"), ~n.between(9, 15)),
    }[kind]
    last = F.lower(F.regexp_extract(v, r"([A-Za-z]+)$", 1))
    listed = {
        "email": _vote(last.isin(ENDINGS), ~last.isin(ENDINGS)),
        "ip": _vote(~v.rlike(RESERVED), v.rlike(RESERVED)),
        "card": _vote(v.rlike(ISSUERS), never),
        "phone": _vote(v.rlike(COUNTRIES), never),
    }[kind]
    shape = {
        "email": _vote(F.length(v) <= 64, F.length(v) > 254),
        "ip": _vote(~v.rlike(r"(^|[.\]])0[0-9]"), v.rlike(r"(^|[.\]])0[0-9]")),
        "card": _vote(n.isin(15, 16), n < 14),
        "phone": _vote(n.between(10, 13), v.rlike(r"^[0-9]{4}[-/.][0-9]{2}[-/.]|^[0-9.]+$")),
    }[kind]
    context = _vote(before.rlike(CUES[kind]), before.rlike(COUNTER))
    return [form, listed, context, _vote(loose, glued), shape]


def described(kind: str, s: Column) -> Column:
    """Votes and the classifier's features of a candidate."""
    v = votes(kind, s)
    features = [
        F.lit(1.0),
        *[x.cast("double") for x in v],
        s["value"].rlike(r"^\+|@").cast("double"),
        s["value"].rlike(r"[ ()-]").cast("double"),
        s["after"].rlike(r"^$|[\s.,;:!?)|]").cast("double"),
    ]
    return F.struct(F.array(*v).alias("votes"), F.array(*features).alias("x"))


def vote_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each pattern of votes and features occurs, per kind: at most a few thousand rows."""
    d = located(docs.select(F.col(text).alias("text")), WIDE, "c_", "text")

    def seen_of(k):
        return F.transform(F.col(f"c_{k}"), lambda s: F.struct(F.lit(k).alias("kind"), described(k, s).alias("d")))

    seen = F.concat(*map(seen_of, KINDS))
    return (
        d.select(F.explode(seen).alias("s"))
        .groupBy("s.kind", "s.d.votes", "s.d.x")
        .agg(F.count("*").cast("double").alias("n"))
    )


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (1.0 + F.exp(-z))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, p: a + f(p))


def reliabilities(patterns: Column) -> Column:
    """Probability of "personal" per pattern, by expectation-maximisation from the majority vote.

    ``patterns`` is an array of structs (votes, x, n).  Each labeler has a distribution over its
    three votes for either truth; counts are smoothed by one.
    """

    def total(pairs, y, at=None):
        def f(p):
            share = p["p"] if y else 1.0 - p["p"]
            hit = F.lit(1.0) if at is None else (
                (F.get(p["q"]["votes"], F.floor(at / 3).cast("int")) == at % 3 - 1).cast("double")
            )
            return p["q"]["n"] * share * hit

        return _sum(pairs, f)

    def round_(p, _):
        return let(F.zip_with(patterns, p, lambda q, y: F.struct(q.alias("q"), y.alias("p"))), update)

    def update(pairs):
        sides = F.array(total(pairs, 0), total(pairs, 1))
        return let(sides, lambda n: let(weights_of(pairs, n), lambda w: expected(w, n)))

    def weights_of(pairs, n):
        return F.transform(
            F.sequence(F.lit(0), F.lit(3 * LABELERS - 1)),
            lambda at: F.log((total(pairs, 1, at) + 1.0) / (F.get(n, F.lit(1)) + 3.0))
            - F.log((total(pairs, 0, at) + 1.0) / (F.get(n, F.lit(0)) + 3.0)),
        )

    def expected(weight, n):
        prior = F.log((F.get(n, F.lit(1)) + 1.0) / (F.get(n, F.lit(0)) + 1.0))
        return F.transform(patterns, lambda q: sigmoid(prior + voted(weight, q)))

    def voted(weight, q):
        return reduce(
            lambda a, b: a + b, [F.get(weight, F.get(q["votes"], F.lit(i)) + (3 * i + 1)) for i in range(LABELERS)]
        )

    start = F.transform(patterns, lambda q: sigmoid(1.5 * F.aggregate(q["votes"], F.lit(0), lambda a, v: a + v)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, round_)


def classifier(patterns: Column, soft: Column) -> Column:
    """Weights of a logistic regression of the soft labels on the features, by gradient descent."""

    def score(w, x):
        return _sum(F.zip_with(w, x, lambda a, b: a * b), lambda t: t)

    def step(w, _, n):
        errors = F.zip_with(
            patterns,
            soft,
            lambda q, y: F.struct(q["x"].alias("x"), (q["n"] * (sigmoid(score(w, q["x"])) - y) / n).alias("e")),
        )
        slope = F.aggregate(
            errors,
            F.array_repeat(F.lit(0.0), FEATURES),
            lambda g, e: F.zip_with(g, e["x"], lambda a, b: a + b * e["e"]),
        )
        return F.zip_with(w, slope, lambda a, g: a - 1.0 * (g + 0.0005 * a))

    rounds, zeros = F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(F.lit(0.0), FEATURES)
    n_all = _sum(patterns, lambda q: q["n"])
    return let(n_all, lambda n: F.aggregate(rounds, zeros, lambda w, r: step(w, r, n)))


def fit(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """The span classifier's weights per kind: at most four short rows reach the driver."""
    counts = vote_counts(docs, text).groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct("votes", "x", "n"))).alias("patterns")
    )
    soft = counts.withColumn("soft", reliabilities(F.col("patterns")))
    rows = soft.select("kind", classifier(F.col("patterns"), F.col("soft")).alias("w")).collect()
    return {r["kind"]: list(r["w"]) for r in rows}


def find(docs: DataFrame, model: dict[str, list[float]], text: str = "text", out: str = "spans") -> DataFrame:
    """Append ``out``: spans (start, rank of kind, end, kind, base) by start, then kind.

    Base spans always stay.  A candidate is added if the classifier is sure, its form labeler is
    not against it, and it meets no span found before.  Null texts count as empty and have no
    spans.  All other columns pass through, whatever their names.
    """
    p, c = fresh(docs, "_b", "_c")
    d = located(base_spans(docs, p, text), {k: w for k, w in WIDE.items() if k in model}, c, text)

    def shaped(k, spans, base):
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                F.lit(KINDS.index(k)).alias("rank"),
                s["end"].alias("end"),
                F.lit(k).alias("kind"),
                F.lit(base).alias("base"),
            ),
        )

    everything = F.concat(*[shaped(k, F.col(p + k), True) for k in KINDS])
    d = d.withColumn(p + "all0", everything)

    def added(k, have):
        weights = F.array(*[F.lit(float(w)) for w in model[k]])

        def sure(s):
            about = described(k, s)
            z = _sum(F.zip_with(weights, about["x"], lambda a, b: a * b), lambda t: t)
            free = ~F.exists(F.col(have), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return free & (F.get(about["votes"], F.lit(0)) >= 0) & (sigmoid(z) >= SURE)

        more = shaped(k, F.filter(F.col(c + k), sure), False)
        return F.when(F.size(c + k) > 0, F.concat(F.col(have), more)).otherwise(F.col(have))

    kinds = [k for k in KINDS if k in model]
    for step, k in enumerate(kinds):
        d = d.withColumn(p + f"all{step + 1}", added(k, p + f"all{step}"))
    step = len(kinds)
    keep = [F.col(f"`{x}`") for x in docs.columns]
    return d.select(*keep, F.array_sort(p + f"all{step}").alias(out))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace every span in ``text`` by its kind in brackets; drops ``spans``.

    Where spans of two kinds meet, the earlier one names the place and both are covered.  Null
    texts stay null.
    """
    src = F.col(text)

    def step(a, s):
        gap = F.substr(src, a["to"] + 1, s["start"] - a["to"])
        covered = s["start"] < a["to"]
        mark = F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(a["to"], s["end"]).alias("to"),
            F.when(covered, a["parts"]).otherwise(F.array_append(a["parts"], mark)).alias("parts"),
        )

    done = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("to"), F.array().cast("array<string>").alias("parts")),
        step,
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(src, a["to"] + 1)),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(src)).drop(spans)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with counts per base kind and the written spans.

    Null and empty texts have no spans, and their digest is that of the empty string.  Rows without
    an id and repeated rows are rows like others; an empty table gives none.  Texts are read whole.
    Only ``doc_id`` and ``text`` are looked at.
    """
    found = find(docs.select("doc_id", "text"), fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
