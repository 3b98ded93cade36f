"""Invariants of splits, samples and generation."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from uttermark.functions.tags import bio_error, place_slots
from uttermark.functions.text import word_tokens
from uttermark.operators import generate, splits
from uttermark.session import literal_table


@pytest.fixture(scope="module")
def rows(spark):
    """Classes of 180, 19 and 1 rows."""
    c = F.when(F.col("id") == 7, "single").when(F.col("id") % 10 == 0, "rare").otherwise("hot")
    return spark.range(200).select("id", c.alias("c"), (F.col("id") % 23).alias("g"))


def sizes(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_group_split_keeps_groups_whole(rows):
    d = splits.group_split(rows, "g", (10, 5, 5))
    per = d.select("g", "split").distinct()
    assert per.count() == per.select("g").distinct().count() == 23 and d.count() == 200
    assert sizes(per, "split") == {("train",): 13, ("dev",): 5, ("test",): 5}
    exact = splits.group_split(rows, "g", (10, 5, 5), exact=True).select("g", "split").distinct()
    assert sizes(exact, "split") == {("train",): 10, ("dev",): 5, ("test",): 5, ("unused",): 3}
    # The published sizes.
    small = splits.group_split(rows, "g", (4488, 490, 893)).select("g", "split").distinct()
    assert sizes(small, "split") == {("train",): 19, ("dev",): 1, ("test",): 3}


def test_fraction_edges(rows):
    def n(f):
        return sizes(splits.stratified_fraction(rows, ["c"], ["id"], f), "c")

    total = sizes(rows, "c")
    assert n(0.0) == {} and n(1.0) == total
    assert n(0.05) == {("hot",): round(total[("hot",)] * 0.05), ("rare",): 1, ("single",): 1}


def test_folds_are_balanced_and_cells_complete(rows):
    f = splits.stratified_kfold(rows, ["c"], ["id"], 5)
    per = sizes(f, "c", "fold")
    for c in ("hot", "rare", "single"):
        counts = [per.get((c, k), 0) for k in range(5)]
        assert max(counts) - min(counts) <= 1
    cells = splits.fold_cells(f, 5)
    assert cells.count() == 1000 and cells.where("role = 'test'").count() == 200


def test_holdout_is_shared_and_leak_free(rows):
    a = splits.holdout(rows, ["c"], ["id"]).orderBy("id").collect()
    b = splits.holdout(rows.repartition(5), ["c"], ["id"]).orderBy("id").collect()
    assert a == b
    s = splits.holdout(rows, ["c"], ["id"])
    leak = splits.assert_no_leak(s.where("split = 'train'"), s.where("split = 'test'"), "id").first()
    assert leak.n_leaked == 0 and leak.n_refs == s.where("split = 'train'").count()


def test_sweep_cells_are_nested(rows):
    real, synth = rows.where("id < 100"), rows.where("id >= 100")
    d = splits.ratio_sweep(real, synth, [0.0, 0.1, 1.0], ["c"], ["id"])
    got = {r.cell: (r.n_train, r.n_real, r.n_synthetic) for r in splits.cell_sizes(d).collect()}
    assert got["0.00"] == (100, 0, 100) and got["1.00"] == (200, 100, 100) and got["real_only"] == (100, 100, 0)
    tenth = {r.id for r in d.where("array_contains(cells, '0.10') AND origin = 'real'").collect()}
    assert len(tenth) == got["0.10"][1] and all(i < 100 for i in tenth)


def test_low_resource_cut(spark, rows):
    d = rows.select("id", F.lit("hi").alias("lang"), F.lit("train").alias("split"), F.col("c").alias("intent"))
    cfg = literal_table(spark, "lang string, split string, target int, excluded string", [("hi", "train", 50, "RARE")])
    got = splits.low_resource_cut(d, cfg, ["id"])
    assert got.count() == 50 and got.where("intent = 'rare'").count() == 0


def test_exact_samples(rows):
    assert splits.sample_n(rows, ["id"], 30).count() == 30
    assert sizes(splits.dev_holdout(rows, ["id"]), "split") == {("dev",): 20, ("train",): 180}
    assert sizes(splits.stratified_n(rows, ["c"], ["id"], 20, floor=1), "c")[("single",)] == 1


# ---- generation ---------------------------------------------------------------------


def test_quotas_sum_to_total(spark):
    d = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "i string, w bigint")
    assert {r.i: r.quota for r in generate.quotas(d, "i", "w", 100).collect()} == {"a": 56, "b": 33, "c": 11}


@pytest.fixture(scope="module")
def made(spark):
    tpl = literal_table(spark, "intent string, template string", [("go", "from {city.from} to {city.to} via {city.via}"), ("no", "stop")])
    vals = [("city", 0, v) for v in ("new york", "rome", "oslo")]
    pools = generate.value_pool(literal_table(spark, "pool string, branch int, value string", vals))
    wanted = literal_table(spark, "intent string, n_attempts bigint", [("go", 200), ("no", 20)])
    return generate.expand_templates(tpl, pools, wanted, ["intent"], 1, distinct=("city",)).cache()


def test_distinct_slots_never_repeat(made):
    rows = made.where("intent = 'go'").collect()
    assert len(rows) == 200 and all(len({s.value for s in r.slots}) == 3 for r in rows)
    assert len({r.command for r in rows}) == 6  # all orders of three cities come up
    assert all("".join(c.text for c in r.chunks) == r.command for r in rows)


def test_generated_tags_are_valid(made):
    k = word_tokens(F.col("command"))
    assert made.where(bio_error(k, place_slots(k, F.col("slots"))) != "").count() == 0


def test_quota_and_shortfall(spark, made):
    q = literal_table(spark, "intent string, quota bigint", [("go", 4), ("no", 5)])
    kept = generate.fill_quota(made, q, ["intent"], ["command"])
    got = {r.intent: (r.n_got, r.missing) for r in generate.shortfall(kept, q, ["intent"]).collect()}
    assert got == {"go": (4, 0), "no": (1, 4)}


def test_permutation_of_any_size(spark):
    for n in (1, 2, 7, 1000):
        at = generate.permuted(F.col("id"), F.lit(n).cast("bigint"), 3, "k")
        got = [r.x for r in spark.range(n).withColumn("k", F.lit("a")).select("id", at.alias("x")).orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and (n < 1000 or got != sorted(got))


def test_equal_shares_fill_in_turns(spark):
    """The shares are those of dealing one at a time, small units first."""
    for sizes, quota in (([5, 1, 9], 8), ([2, 2], 9), ([0, 4], 3), ([3], 0), ([10, 10, 10], 11)):
        df = spark.createDataFrame([("g", i, n, quota) for i, n in enumerate(sizes)], "g string, u int, n bigint, q bigint")
        got = {r.u: r.share for r in generate.equal_shares(df, ["g"], ["u"], "n", "q", "share").collect()}
        turn = sorted(range(len(sizes)), key=lambda i: (min(sizes[i], quota), i))
        deal = sorted((j, turn.index(i), i) for i in turn for j in range(sizes[i]))[:quota]
        assert got == {i: sum(d[2] == i for d in deal) for i in turn}, (sizes, quota)


def test_distinct_texts_draw_on_over_equal_readings(spark):
    """Two pools share values, so half the combinations of the first group read like others."""
    vals = [("a", 0, str(i)) for i in range(20)] + [("b", 0, str(i)) for i in range(10, 20)] + [("b", 1, "x")]
    pools = generate.value_pool(literal_table(spark, "pool string, branch int, value string", vals))
    tpl = literal_table(spark, "g string, template string", [("one", "go {a}"), ("one", "go {b}"), ("two", "go {a}"), ("two", "run {a} {b}")])
    quota = literal_table(spark, "g string, quota bigint", [("one", 30), ("two", 40)])
    kept, short = generate.distinct_texts(tpl, pools, quota, ["g"], ["command"], ["g"])
    rows = kept.collect()
    assert len({r.command for r in rows}) == len(rows)
    assert {r.command for r in rows if r.g == "one"} == {f"go {v}" for v in [*range(20), "x"]}
    assert {r.g: (r.n_got, r.missing) for r in short.collect()} == {"one": (21, 9), "two": (40, 0)}
    again = generate.distinct_texts(tpl, pools, quota, ["g"], ["command"], ["g"])[0]
    assert sorted(r.command for r in again.collect()) == sorted(r.command for r in rows)
    none, short = generate.distinct_texts(tpl, pools, quota.limit(0), ["g"], ["command"], ["g"])
    assert none.count() == 0 and short.count() == 0


def test_coverage_copies_are_clamped(spark):
    carriers = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(10)], "utt_id int, intent string, text string")
    missing = spark.createDataFrame([("attic", 100), ("barn", 50), ("den", 1)], "value string, n bigint")
    got = Counter(r.value for r in generate.expand_coverage(carriers, missing, ["utt_id"]).collect())
    assert got == {"attic": 20, "barn": 10, "den": 3}


def test_translations_share_the_canonical_value(spark):
    v = spark.createDataFrame([("c", "red", None), ("c", "pink", "red"), ("b", "10", None)], "slot_type string, value string, canonical string")
    d = spark.createDataFrame([("c", "red", "rouge")], "slot_type string, value string, translated string")
    got = {r.value: r.translated for r in generate.translation_table(v, d).collect()}
    assert got == {"red": "rouge", "pink": "rouge", "10": "10"}
