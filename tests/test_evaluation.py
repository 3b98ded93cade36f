"""Metrics, diagnostics and selection on hand-worked frames."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from uttermark.operators import audit, diagnose, match, metrics, selection, similarity, vocab

PAIR = "utt_id int, gold_intent string, pred_intent string, g array<struct<slot_name:string,raw_value:string>>, p array<struct<slot_name:string,raw_value:string>>"


def test_bag_match_uses_each_gold_once(spark):
    rows = [
        (1, "a", "a", [("room", "Hall"), ("room", "hall")], [("room", "hall")]),
        (2, "a", None, [("room", "hall")], [("room", "hall"), ("color", "red")]),
    ]
    df = spark.createDataFrame(rows, PAIR)
    got = {(r.utt_id, r.slot_name): (r.tp, r.fp, r.fn) for r in match.bag_match(df, ["utt_id"], "g", "p").collect()}
    assert got == {(1, "room"): (1, 0, 1), (2, "room"): (1, 0, 0), (2, "color"): (0, 1, 0)}
    gated = match.bag_match(df, ["utt_id"], "g", "p", require_intent=True)
    got = {(r.utt_id, r.slot_name): (r.tp, r.fp, r.fn) for r in gated.collect()}
    assert got == {(1, "room"): (1, 0, 1), (2, "room"): (0, 0, 1)}


def test_prf_null_prediction_is_only_a_miss(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("b", "b")], "g string, p string")
    got = {r["class"]: (r.tp, r.fp, r.fn) for r in metrics.prf_by_class(df, "g", "p").collect()}
    assert got == {"a": (1, 0, 1), "b": (1, 1, 1), None: (2, 1, 2)}
    assert [tuple(r) for r in metrics.confusion(df, "g", "p").orderBy("gold").collect()] == [("a", "b", 1), ("b", "None", 1)]
    acc = {r.g: (r.tp, r.n) for r in metrics.accuracy(df.withColumn("ok", F.col("g").eqNullSafe(F.col("p"))), "g", "ok").collect()}
    assert acc == {"a": (1, 2), "b": (1, 2), None: (2, 4)}
    nulls = spark.createDataFrame([("a", True), (None, True), (None, False)], "g string, ok boolean")
    rows = {(r.g, r.is_total): (r.tp, r.n) for r in metrics.accuracy(nulls, "g", "ok").collect()}
    assert rows == {("a", False): (1, 1), (None, False): (1, 2), (None, True): (2, 3)}


def test_empty_denominators_give_zero(spark):
    df = spark.createDataFrame([(0, 0, 0)], "tp int, fp int, fn int")
    r = metrics.with_prf(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_fold_summary_and_sides(spark):
    rows = [("base", 0, "acc", 0.5), ("base", 1, "acc", 0.7), ("x", 0, "acc", 0.8), ("x", 1, "acc", 0.8)]
    m = spark.createDataFrame(rows, "experiment string, fold int, metric string, value double")
    added = spark.createDataFrame([("x", 10)], "experiment string, n_added int")
    got = {r.experiment: r for r in metrics.fold_summary(m, "base", added).collect()}
    assert got["base"].std == pytest.approx(0.1) and got["x"].delta_pp == pytest.approx(20.0)
    assert got["x"].delta_pp_per_row == pytest.approx(2.0) and got["base"].delta_pp_per_row is None
    s = spark.createDataFrame([("a", "real", 0.9), ("a", "synthetic", 0.8), ("b", "real", 0.5)], "m string, side string, value double")
    got = {r.m: (r.shown) for r in metrics.compare_sides(s, ["m"]).collect()}
    assert got == {"a": "+10.00", "b": "n/a"}


def outcomes(spark):
    rng = random.Random(2)
    rows = [(s, float(rng.randint(0, 5)), int(rng.random() < 0.3 + s / 10)) for s in range(5) for _ in range(4 + 3 * s)]
    return rows, spark.createDataFrame(rows, "s int, x double, ok int")


def test_eta_squared_and_within_effect(spark):
    rows, df = outcomes(spark)
    grand = statistics.mean(r[2] for r in rows)
    groups = {s: [r for r in rows if r[0] == s] for s in {r[0] for r in rows}}
    between = sum(len(g) * (statistics.mean(r[2] for r in g) - grand) ** 2 for g in groups.values())
    total = sum((r[2] - grand) ** 2 for r in rows)
    assert diagnose.eta_squared(df, "s", "ok").first()[0] == pytest.approx(between / total)
    lows, highs = [], []
    for g in groups.values():
        med = statistics.median(r[1] for r in g)
        lo, hi = [1 - r[2] for r in g if r[1] <= med], [1 - r[2] for r in g if r[1] > med]
        if len(g) >= 8 and lo and hi:
            lows.append(statistics.mean(lo))
            highs.append(statistics.mean(hi))
    r = diagnose.within_group_effect(df, "s", "x", "ok").first()
    assert r.n_groups == len(lows)
    assert r.effect_pp == pytest.approx(100 * (statistics.mean(lows) - statistics.mean(highs)))
    same = spark.createDataFrame([(1, 1), (2, 1)], "s int, ok int")
    assert diagnose.eta_squared(same, "s", "ok").first()[0] == 0.0


def test_quantile_bucket_upper_bound_is_inclusive(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 3, 4, 5, 5]], "x double")
    got = sorted(tuple(r) for r in diagnose.quantile_bucket(df, "x").collect())
    # quartiles are 1, 2.5 and 4.25
    assert [b for _, b in got] == [1, 1, 1, 2, 3, 3, 4, 4]


def test_time_features_short_silent_and_partial(spark):
    rows = [(1, 20, i, 0.5) for i in range(3)]  # below two windows of 2 samples
    rows += [(2, 20, i, 0.0) for i in range(6)]  # silent
    rows += [(3, 20, i, a) for i, a in enumerate([0.1, 0.1, 0.4, 0.4, 1.0])]  # partial last window
    df = spark.createDataFrame(rows, "clip_id int, sr int, pos int, amp double")
    got = {r.clip_id: r for r in diagnose.time_features(df).collect()}
    assert got[1].snr_db == pytest.approx(0.0) and got[1].noise_floor_rms == pytest.approx(0.5)
    assert got[2].rms == pytest.approx(1e-6) and got[2].peak == 0.0
    assert got[3].noise_floor_rms == pytest.approx(0.13, abs=1e-4) and got[3].speech_rms == pytest.approx(0.37, abs=1e-4)
    assert got[3].duration == 0.25 and got[3].peak == 1.0


def test_pick_until_stop_rules(spark):
    def group(g, ds):
        return [(g, i, d) for i, d in enumerate(ds)]

    rows = group("reach", [3.0, 3.0, 1.0]) + group("over", [5.0, 5.0]) + group("short", [1.0, 2.0]) + group("long", [12.0, 1.0])
    df = spark.createDataFrame(rows, "g string, pos int, d double")
    got = selection.pick_until(df, "g", "d", [F.col("pos")])
    kept = sorted((r.g, r.pos) for r in got.collect())
    assert kept == [("long", 0), ("over", 0), ("reach", 0), ("reach", 1)]


def test_pick_closest_and_diverse(spark):
    rows = [("s", i, i % 3, float(d)) for i, d in enumerate([13, 7, 5, 6.5, 5.5, 12, 9, 4])]
    df = spark.createDataFrame(rows, "s string, pos int, c int, d double")
    assert selection.pick_closest(df, "s", "d", ["pos"]).first().pos == 3  # earliest of 6.5 and 5.5
    got = selection.pick_diverse(df, "s", "c", "d", ["pos"], k=4).orderBy("ref_idx").collect()
    assert [(r.c, r.d) for r in got] == [(0, 9.0), (0, 6.5), (1, 7.0), (2, 12.0)]
    rr = selection.round_robin(spark.range(7), "id", 3, 2).orderBy("id").collect()
    assert [(r.speaker, r.ref_idx) for r in rr] == [(0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1), (0, 0)]


def test_similarity_leaves_one_out(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", [0.0, 1.0]), (2, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, s string, v array<float>")
    got = {r.i: r for r in similarity.centroid_similarity(df, "i", "s", "v").collect()}
    assert got[0].self_cos == pytest.approx(0.0) and got[0].cross_cos == pytest.approx(2**-0.5, abs=1e-6)
    assert got[2].self_cos is None


def test_inventories(spark):
    e = spark.range(0, 30).select(F.col("id").alias("k"))
    a = spark.range(5, 33).select(F.col("id").alias("k"))
    got = {r.side: (r.n_keys, r.examples) for r in match.diff_inventory(e, a, "k", 3).collect()}
    assert got == {"missing": (5, [0, 1, 2]), "extra": (3, [30, 31, 32])}
    df = spark.createDataFrame([("A b", "x"), ("a b ", "y"), ("a b", "x"), ("c", "x")], "t string, l string")
    assert [(r.n_copies, r.n_labels) for r in audit.duplicate_texts(df, "t", "l").collect()] == [(3, 2)]
    words = spark.createDataFrame([(["b", "B", "a", "c", "c"],)], "k array<string>")
    got = [(r.word, r.idx) for r in vocab.build_vocab(words, "k", 2).orderBy("idx").collect()]
    assert got == [("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2), ("[SEP]", 3), ("b", 4), ("c", 5)]
    new = vocab.unseen_values(words.select(F.explode("k").alias("w")), words.select(F.lit("B").alias("w")), "w", ["a"])
    assert [tuple(r) for r in new.collect()] == [("c", 2)]


def test_keyword_rules_first_pattern_of_other_intents(spark):
    df = spark.createDataFrame([(1, "Block my card, balance", "block"), (2, "hello", "block")], "i int, t string, c string")
    rules = {"block": ["block"], "balance": ["how much", "balance", "card"], "pin": ["pin"]}
    got = [(r.i, r.suggested, r.pattern) for r in match.keyword_confusion(df, "t", "c", rules).collect()]
    assert got == [(1, "balance", "balance")]


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([("room", "Hall", 0)], "entity string, value string, pos int")
    b = spark.createDataFrame([("room", "hall", 0), ("room", "Attic", 1), ("room", "attic", 2)], "entity string, value string, pos int")
    got = sorted((r.value, r.origin) for r in match.merge_gazetteers(a, b).collect())
    assert got == [("Attic", "b"), ("Hall", "a")]
    old = spark.createDataFrame([("en", 1.0, 5), ("fr", 2.0, None)], "lang string, bert double, n int")
    new = spark.createDataFrame([("en", 9.0, 6), ("de", 3.0, 7)], "lang string, bert double, n int")
    got = sorted(tuple(r) for r in match.upsert(old, new, "lang", ["bert"], ["n"]).collect())
    assert got == [("de", 3.0, 7), ("en", 9.0, 5), ("fr", 2.0, None)]
