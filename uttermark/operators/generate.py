"""Template-driven generation of annotated utterances.

Every random choice is a hash of (seed, group, attempt, slot), so the result does not
depend on partitioning and can be recomputed after a loss.  The rejection loop becomes
rows: all attempts are generated, copies fall to their first attempt, and the first rows
up to the quota are kept.  Where texts only have to differ, combinations are numbered and
drawn by a keyed permutation, without attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.functions.util import let
from uttermark.operators.order import ORDER_CELLS, first_seen, ranked, running
from uttermark.session import sized

CHUNK = 10_000  # attempts built by one task at a time


def draw(seed: int | str, *keys) -> Column:
    """A number below 2**48 from the hash of the keys."""
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")


def quotas(dist: DataFrame, label: str, weight: str, total: int) -> DataFrame:
    """``label, quota``: weights scaled to the total, half-even; the last (smallest) label
    takes what is left.  One row per label, so a window over all of it is small."""
    scale = dist.agg(F.sum(weight).alias("_sum"))  # one row
    w = W.orderBy(F.desc(weight), F.col(label))
    d = dist.crossJoin(scale)
    d = d.withColumn("_q", F.bround(F.col(weight) * (F.lit(float(total)) / F.col("_sum"))).cast("bigint"))
    d = d.withColumn("_before", F.coalesce(F.sum("_q").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    d = d.withColumn("_last", F.lead(label).over(w).isNull())
    quota = F.when(F.col("_last"), F.lit(total) - F.col("_before")).otherwise(F.col("_q"))
    return d.select(label, quota.alias("quota"))


def value_pool(values: DataFrame) -> DataFrame:
    """``pool, branch, pos, value``: pools numbered for drawing.

    ``values``: ``pool, branch, value``; branch 0 and 1 are the two kinds a pool may mix
    (words and digits).  Synonyms are values like any other.  The source is read once: the
    distinct values and the numbered pools are stored, as generation joins them several times.
    """
    v = values.select("pool", "branch", "value").distinct().withColumn("_h", F.md5("value"))
    cell = F.concat(F.col("branch").cast("string"), F.substring("_h", 1, ORDER_CELLS))
    out = running(sized(v, "values"), ["pool"], [F.col("branch"), F.col("_h"), F.col("value")], cell)
    return sized(out.select("pool", "branch", (F.col("rn") - 1).alias("pos"), "value"), "pools")


def prepare(templates: DataFrame, pools: DataFrame, group: list[str], distinct: list[str]) -> DataFrame:
    """Templates cut into texts and slots, numbered in their group, with pool sizes.

    A placeholder ``{pool.name}`` draws from ``pool``; its slot type is the whole name.
    All of this is work on the templates, not on the attempts, and stored once.
    """
    cut = templates.select(
        *group,
        "template",
        F.split("template", r"\{[^}]+\}").alias("texts"),
        F.regexp_extract_all("template", F.lit(r"\{([^}]+)\}"), F.lit(1)).alias("types"),
    )
    w = W.partitionBy(*group)
    cut = cut.withColumn("t_no", F.row_number().over(w.orderBy("template")) - 1)
    cut = cut.withColumn("n_templates", F.count(F.lit(1)).over(w))
    sizes = pools.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("branch") == 0).alias("n0")
    )
    slots = cut.select(*group, "t_no", F.posexplode("types").alias("s_no", "slot_type"))
    slots = slots.withColumn("pool", F.split("slot_type", r"\.")[0]).join(sizes, "pool")
    slot = F.struct(
        "s_no", "slot_type", "pool", "n", "n0", F.col("pool").isin(distinct).alias("distinct")
    )
    per = slots.groupBy(*group, "t_no").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    return sized(cut.join(per, [*group, "t_no"], "left"), "templates")


def attempt_rows(wanted: DataFrame, group: list[str]) -> DataFrame:
    """One row per attempt from ``wanted(group..., n_attempts)``, built in chunks by many
    tasks."""
    some = wanted.where("n_attempts > 0")
    chunk = F.explode(F.expr(f"sequence(0L, (n_attempts - 1) div {CHUNK})")).alias("_c")
    chunks = some.select(*group, "n_attempts", chunk).repartition(*group, "_c")
    inner = F.expr(f"sequence(_c * {CHUNK}, least((_c + 1) * {CHUNK}, n_attempts) - 1)")
    return chunks.select(*group, F.explode(inner).alias("attempt"))


def _picks(seed: int | str, group: list[str], mix: float) -> Column:
    """Position drawn for each slot.

    A pool with two branches takes the first with probability ``mix``.  Slots of a
    ``distinct`` pool never repeat a value: the r-th still unused position is taken, which
    is found by stepping over the used ones in order.
    """

    def step(acc: Column, s: Column) -> Column:
        h = draw(seed, *group, "attempt", s["s_no"])
        coin = draw(seed, *group, "attempt", s["s_no"], F.lit("coin"))
        mixed = (s["n0"] > 0) & (s["n0"] < s["n"])
        word = coin < F.lit(int(mix * 2**48))
        plain = (
            F.when(~mixed, F.pmod(h, s["n"]))
            .when(word, F.pmod(h, s["n0"]))
            .otherwise(s["n0"] + F.pmod(h, F.greatest(s["n"] - s["n0"], F.lit(1))))
        )
        same_pool = F.filter(acc, lambda p: p["pool"] == s["pool"])

        def unused(used: Column) -> Column:
            r = F.pmod(h, F.greatest(s["n"] - F.size(used), F.lit(1)))
            shifted = F.aggregate(
                F.array_sort(F.transform(used, lambda p: p["pos"])),
                r,
                lambda x, u: F.when(u <= x, x + 1).otherwise(x),
            )
            return F.when(F.size(used) < s["n"], shifted).otherwise(F.pmod(h, s["n"]))

        pos = F.when(s["distinct"], let(same_pool, unused)).otherwise(plain)
        entry = F.struct(
            s["s_no"].alias("s_no"), s["slot_type"].alias("slot_type"), s["pool"].alias("pool"),
            pos.cast("bigint").alias("pos"),
        )
        return F.concat(acc, F.array(entry))

    start = F.array().cast("array<struct<s_no:int,slot_type:string,pool:string,pos:bigint>>")
    return F.aggregate(F.coalesce("slots", F.array().cast(_SLOTS)), start, step)


_SLOTS = "array<struct<s_no:int,slot_type:string,pool:string,n:bigint,n0:bigint,distinct:boolean>>"


def expand_templates(
    templates: DataFrame,
    pools: DataFrame,
    wanted: DataFrame,
    group: list[str],
    seed: int | str = 42,
    distinct: tuple[str, ...] = (),
    mix: float = 0.5,
) -> DataFrame:
    """Attempts as rows: group, ``attempt, command, slots, chunks``.

    Values are joined by (pool, position), so a pool may be a large table.
    """
    ready = prepare(templates, pools, group, list(distinct))
    counts = ready.select(*group, "n_templates").distinct()
    a = attempt_rows(wanted, group).join(counts, group)
    a = a.withColumn("t_no", F.pmod(draw(seed, *group, "attempt", F.lit("t")), F.col("n_templates")).cast("int"))
    a = a.drop("n_templates").join(ready.select(*group, "t_no", "texts", "slots"), [*group, "t_no"])
    a = a.withColumn("picks", _picks(seed, group, mix)).drop("slots")
    return _filled(a, ready, pools, group, ["attempt"])


def _filled(
    drawn: DataFrame, ready: DataFrame, pools: DataFrame, group: list[str], ident: list[str]
) -> DataFrame:
    """Positions drawn (``picks``) to text: adds ``command, slots, chunks`` per row of ``ident``."""
    row = [*group, "t_no", *ident]
    rows = drawn.select(*row, F.explode_outer("picks").alias("p")).select(*row, "p.*")
    rows = rows.join(pools.select("pool", "pos", "value"), ["pool", "pos"], "left")
    value = F.when(F.col("value").isNotNull(), F.struct("s_no", "slot_type", "value"))
    filled = rows.groupBy(*row).agg(
        F.array_sort(F.collect_list(value)).alias("vals")  # at most one per placeholder
    )
    filled = filled.join(ready.select(*group, "t_no", "texts"), [*group, "t_no"])
    pieces = F.filter(
        F.flatten(
            F.zip_with(
                F.transform("texts", lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("slot_name"))),
                F.transform("vals", lambda v: F.struct(v["value"].alias("text"), v["slot_type"].alias("slot_name"))),
                lambda t, v: F.array(t, v),
            )
        ),
        lambda c: c["text"] != "",
    )
    slots = F.transform("vals", lambda v: F.struct(v["slot_type"].alias("slot_type"), v["value"].alias("value")))
    out = filled.select(*group, *ident, slots.alias("slots"), pieces.alias("chunks"))
    return out.withColumn("command", F.array_join(F.transform("chunks", lambda c: c["text"]), ""))


def fill_quota(
    attempts: DataFrame, quota: DataFrame, group: list[str], key: list[str], priority: list[str] = ()
) -> DataFrame:
    """Keep each key's first attempt, then the first ``quota`` rows of every group.

    Attempts that are not ``valid`` (when there is such a column) do not count.
    """
    if "valid" in attempts.columns:
        attempts = attempts.where("valid").drop("valid")
    order = [*priority, *group, "attempt"]
    # Stored, as its cells are counted before its rows are numbered.
    uniq = sized(first_seen(attempts, key, list(dict.fromkeys(order))), "unique")
    r = running(uniq, group, [F.col("attempt")], F.expr(f"attempt div {CHUNK}"))
    return r.join(quota.select(*group, "quota"), group).where("rn <= quota").drop("rn", "quota")


def shortfall(kept: DataFrame, quota: DataFrame, group: list[str]) -> DataFrame:
    """Rows wanted, got and missing per group."""
    got = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("n_got"))
    out = quota.select(*group, "quota").join(got, group, "left").na.fill(0, ["n_got"])
    return out.withColumn("missing", F.col("quota") - F.col("n_got"))


def split_quota(total: Column, no_slot: float) -> Column:
    """Two quotas, with and without a slot, as rows for ``inline``."""
    without = F.bround(total * F.lit(no_slot)).cast("bigint")
    return F.array(
        F.struct(F.lit(True).alias("with_slot"), (total - without).cast("bigint").alias("quota")),
        F.struct(F.lit(False).alias("with_slot"), without.alias("quota")),
    )


def _choose_intent(templates: DataFrame) -> DataFrame:
    """Templates with their intent inside, so that one draw chooses both."""
    return templates.withColumn("template", F.concat("intent", F.lit("\u0001"), "template"))


def _split_intent(attempts: DataFrame) -> DataFrame:
    out = attempts.withColumn("intent", F.substring_index("command", "\u0001", 1))
    return out.withColumn("command", F.substring_index("command", "\u0001", -1))


ROUNDS = 24  # of the permutation behind distinct draws


def permuted(x: Column, n: Column, seed: int | str, *keys: str) -> Column:
    """A permutation of ``0..n-1`` chosen by seed and keys, at place ``x``; any n.

    Swap-or-not: a round pairs every number with its mirror image about a keyed point, and a
    keyed bit of the pair says whether the two change places.
    """

    def step(at: Column, r: Column) -> Column:
        def swap(mirror: Column) -> Column:
            bit = draw(seed, *keys, r, F.greatest(at, mirror)) % 2
            return F.when(bit == 1, mirror).otherwise(at)

        return let(F.pmod(draw(seed, *keys, r) % n - at, n), swap)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), step)


def equal_shares(units: DataFrame, group: list[str], key: list[str], size: str, quota: str, out: str):
    """Share ``quota`` of a group equally among its units, none above its ``size``; what a small
    unit cannot take goes to the others.  A group is one template list, so a window is small.

    Taking more never takes another: the shares of a larger quota hold those of a smaller.
    """
    w = W.partitionBy(*group)
    up = w.orderBy("_size", *key)
    u = units.withColumn("_size", F.least(F.col(size), F.col(quota)))
    u = u.withColumn("_no", F.row_number().over(up)).withColumn(
        "_below", F.coalesce(F.sum("_size").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    u = u.withColumn("_open", F.count(F.lit(1)).over(w) - F.col("_no") + 1)
    u = u.withColumn("_full", F.col("_below") + F.col("_size") * F.col("_open") <= F.col(quota))
    first = F.min(F.when(~F.col("_full"), F.struct("_no", "_below", "_open"))).over(w)
    u = u.withColumn("_first", first).withColumn("_left", F.col(quota) - F.col("_first._below"))
    extra = F.col("_no") - F.col("_first._no") < F.col("_left") % F.col("_first._open")
    level = F.expr("_left div _first._open") + extra.cast("bigint")
    share = F.when(F.col("_full"), F.col("_size")).otherwise(level)
    return u.withColumn(out, share).drop("_size", "_no", "_below", "_open", "_full", "_first", "_left")


def _variants(ready: DataFrame, group: list[str]) -> DataFrame:
    """Each template once per choice of branches: the ``radix`` of its slots, and how many
    combinations of values that gives.  Their number must fit a bigint (else an error)."""

    def part(s: Column, start: Column, n: Column) -> Column:
        return F.struct(
            s["s_no"].alias("s_no"), s["slot_type"].alias("slot_type"), s["pool"].alias("pool"),
            start.cast("bigint").alias("start"), n.cast("bigint").alias("n"),
        )

    def branches(s: Column) -> Column:
        mixed = (s["n0"] > 0) & (s["n0"] < s["n"])
        two = F.array(part(s, F.lit(0), s["n0"]), part(s, s["n0"], s["n"] - s["n0"]))
        return F.when(mixed, two).otherwise(F.array(part(s, F.lit(0), s["n"])))

    kind = "array<array<struct<s_no:int,slot_type:string,pool:string,start:bigint,n:bigint>>>"
    every = F.aggregate(
        F.coalesce("slots", F.array().cast(_SLOTS)),
        F.array(F.array()).cast(kind),
        lambda acc, s: F.flatten(
            F.transform(acc, lambda a: F.transform(branches(s), lambda b: F.concat(a, F.array(b))))
        ),
    )
    out = ready.select(*group, "t_no", F.posexplode(every).alias("v_no", "radix"))
    size = F.aggregate("radix", F.lit(1).cast("bigint"), lambda acc, s: acc * s["n"])
    out = out.withColumn("size", size)
    return out.withColumn("t_size", F.sum("size").over(W.partitionBy(*group, "t_no")))


def _decoded(number: Column) -> Column:
    """The picks of a numbered combination, by mixed radix, first slot fastest."""

    def step(acc: Column, s: Column) -> Column:
        pos = s["start"] + F.pmod(acc["rest"], s["n"])
        entry = F.struct(
            s["s_no"].alias("s_no"), s["slot_type"].alias("slot_type"), s["pool"].alias("pool"), pos.alias("pos")
        )
        rest = F.call_function("div", acc["rest"], s["n"])
        return F.struct(rest.alias("rest"), F.concat(acc["picks"], F.array(entry)).alias("picks"))

    none = F.array().cast("array<struct<s_no:int,slot_type:string,pool:string,pos:bigint>>")
    start = F.struct(number.cast("bigint").alias("rest"), none.alias("picks"))
    return F.aggregate("radix", start, step)["picks"]


def distinct_draws(
    templates: DataFrame, pools: DataFrame, asked: DataFrame, group: list[str], seed: int | str = 42
) -> DataFrame:
    """``asked(group..., quota)`` different combinations of template and values per group, all of
    them where there are no more: group, ``t_no, v_no, draw, command, slots, chunks``.

    Templates share the quota equally as far as they go, and so do the kinds of values (words,
    digits) in a template.  The draws of each are the first places of a keyed permutation of
    its numbered combinations: nothing is tried twice or thrown away.
    """
    ready = prepare(templates, pools, group, [])
    return _draws(ready, _variants(ready, group), pools, asked, group, seed)


def _draws(ready, units, pools, asked, group, seed):
    unit = [*group, "t_no"]
    whole = units.select(*unit, "t_size").distinct().join(asked.select(*group, "quota"), group)
    whole = equal_shares(whole, group, ["t_no"], "t_size", "quota", "t_share")
    parts = units.drop("t_size").join(whole.select(*unit, "t_share"), unit)
    parts = equal_shares(parts, unit, ["v_no"], "size", "t_share", "n_attempts")
    places = attempt_rows(parts, [*unit, "v_no"]).withColumnRenamed("attempt", "draw")
    d = places.join(parts.select(*unit, "v_no", "radix", "size"), [*unit, "v_no"])
    d = d.withColumn("_number", permuted(F.col("draw"), F.col("size"), seed, *unit, "v_no"))
    d = d.withColumn("picks", _decoded(F.col("_number")))
    return _filled(d, ready, pools, group, ["t_no", "v_no", "draw"])


def distinct_texts(
    templates: DataFrame,
    pools: DataFrame,
    quota: DataFrame,
    group: list[str],
    key: list[str],
    priority: list[str] = (),
    seed: int | str = 42,
    finish=lambda made: made,
) -> tuple[DataFrame, DataFrame]:
    """``quota`` rows per group, unique by ``key``, and rows wanted, got and missing.

    Different combinations may read the same (a value in two pools, two templates alike).
    Such a text counts for the first group in ``priority`` and group order; groups that end
    up short draw on, doubling their draws, until the quota is met or no combination is
    left.  So ``missing`` is exact.  Only whether a group is still short reaches the driver.
    ``finish`` adds the columns that ``key`` and ``priority`` name.
    """
    ready = prepare(templates, pools, group, [])
    units = sized(_variants(ready, group), "units")
    space = units.groupBy(*group).agg(F.sum("size").alias("_space"))
    ask = quota.select(*group, F.col("quota").alias("_want"), "quota")
    order = list(dict.fromkeys([*priority, *group, "draw", "t_no", "v_no"]))
    while True:
        made = finish(_draws(ready, units, pools, ask, group, seed))
        uniq = sized(first_seen(made, key, order), "unique")
        have = uniq.groupBy(*group).agg(F.count(F.lit(1)).alias("_have"))
        state = ask.join(space, group).join(have, group, "left").na.fill(0, ["_have"])
        short = (F.col("_have") < F.col("_want")) & (F.col("quota") < F.col("_space"))
        state = sized(state.withColumn("_short", short), "state")
        if state.where("_short").isEmpty():
            break
        ask = state.withColumn("quota", F.when(F.col("_short"), F.col("quota") * 2).otherwise(F.col("quota")))
        ask = ask.select(*group, "_want", "quota")
    place = [F.col("draw"), F.col("t_no"), F.col("v_no")]
    r = running(uniq, group, place, F.expr(f"draw div {CHUNK}"))
    r = r.join(quota.select(*group, "quota"), group).where("rn <= quota").drop("rn", "quota")
    return r, shortfall(r, quota, group)


def family_ablation(
    templates: DataFrame, pools: DataFrame, budget: int, no_slot: float = 0.25, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    """New utterances of every register family at once, each family with the same budget.

    ``templates``: ``family, with_slot, intent, template``.  Unique per (family, intent,
    text); ``no_slot`` of the budget goes to templates without the main slot.  Also returns
    rows wanted, got and missing per family.
    """
    group = ["family", "with_slot"]
    fams = templates.select("family").distinct()
    quota = sized(fams.select("family", F.inline(split_quota(F.lit(budget), no_slot))), "quotas")

    def finish(made: DataFrame) -> DataFrame:
        return _split_intent(made).withColumn("_p", (~F.col("with_slot")).cast("int"))

    kept, missing = distinct_texts(
        _choose_intent(templates), pools, quota, group, ["family", "intent", "command"], ["_p"], seed, finish
    )
    return kept.drop("_p"), missing


def augment(
    templates: DataFrame, pools: DataFrame, counts: DataFrame, no_slot: float = 0.25, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    """Targeted augmentation: ``counts(intent, target)`` new utterances per intent, part of
    them without the slot, unique per (pattern, text) over all intents.  Also returns rows
    wanted, got and missing per group."""
    group = ["intent", "with_slot"]
    quota = sized(counts.select("intent", F.inline(split_quota(F.col("target"), no_slot))), "quotas")
    return distinct_texts(
        templates, pools, quota, group, ["with_slot", "command"], ["intent"], seed
    )


def expand_coverage(
    carriers: DataFrame,
    missing: DataFrame,
    key: list[str],
    lo: int = 3,
    hi: int = 20,
    seed: int | str = 42,
) -> DataFrame:
    """New rows for values the synthetic side lacks.

    ``missing(value, n)`` gets ``clamp(lo, round(n / max * hi), hi)`` copies; each draws an
    intent and then a carrier row of that intent.  Carriers are looked up by their number
    in the intent.
    """
    top = missing.agg(F.max("n").alias("_max"))  # one row
    k = F.greatest(F.lit(lo), F.least(F.bround(F.col("n") / F.col("_max") * hi).cast("int"), F.lit(hi)))
    copies = missing.crossJoin(top).select("value", F.explode(F.sequence(F.lit(1), k)).alias("copy"))
    numbered = ranked(carriers, ["intent"], key, f"carrier-{seed}", "_rn")
    sizes = carriers.groupBy("intent").agg(F.count(F.lit(1)).alias("_size"))
    intents = sizes.withColumn("_no", F.row_number().over(W.orderBy("intent")) - 1)  # one row per intent
    total = sizes.agg(F.count(F.lit(1)).alias("_k"))  # one row
    c = copies.crossJoin(total)
    c = c.withColumn("_no", F.pmod(draw(seed, "value", "copy", F.lit("intent")), F.col("_k")).cast("int"))
    c = c.drop("_k").join(intents, "_no")
    c = c.withColumn("_rn", F.pmod(draw(seed, "value", "copy", F.lit("row")), F.col("_size")) + 1)
    return c.drop("_no", "_size").join(numbered, ["intent", "_rn"]).drop("_rn")


def translation_table(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``slot_type, value, translated``: a synonym shares its canonical value's translation,
    digits stay as they are.

    ``values``: ``slot_type, value, canonical`` (canonical is null for main values);
    ``dictionary``: ``slot_type, value, translated``.
    """
    d = dictionary.select("slot_type", F.col("value").alias("_main"), "translated")
    v = values.withColumn("_main", F.coalesce("canonical", "value"))
    out = v.join(d, ["slot_type", "_main"], "left")
    digits = F.col("value").rlike("^[0-9]+$")
    text = F.when(digits, F.col("value")).otherwise(F.col("translated"))
    return out.select("slot_type", "value", text.alias("translated"))
