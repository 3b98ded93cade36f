"""Ordered primitives equal a plain window, also when one group holds most rows."""

import random
import statistics

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.operators import order


def skewed(spark, n=3000):
    """Group 'hot' holds 90 % of the rows; one group is null."""
    g = F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 == 0, None).otherwise("cold")
    return spark.range(n).select("id", g.alias("g"), (F.col("id") * 7919 % 101 / 4.0).alias("x"))


def test_ranked_equals_window(spark):
    df = skewed(spark)
    h = order.hash_of(42, "id")
    plain = df.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy(h, "id")))
    got = order.ranked(df, ["g"], ["id"], 42, "rn", "n").join(plain.select("id", "want"), "id")
    assert got.count() == 3000
    assert got.where("rn <> want").count() == 0
    totals = {r.g: r.n for r in got.select("g", "n").distinct().collect()}
    assert totals == {"hot": 2700, "cold": 150, None: 150}


def test_running_sum_equals_window(spark):
    df = skewed(spark)
    w = W.partitionBy("g").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    plain = df.withColumn("want", F.sum("x").over(w))
    got = order.running(df, ["g"], [F.col("id")], F.expr("id div 100"), F.col("x"), "cum")
    assert got.join(plain.select("id", "want"), "id").where("abs(cum - want) > 1e-6").count() == 0


def test_exact_percentiles(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([-3.5, 0.0, 1e-9, 2.0, 2.0, 7.25, 1e12])) for _ in range(500)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in order.exact_percentiles(df, ["g"], "x", {"p50": 50, "p90": 90}).collect()}
    hot = [x for g, x in rows if g == "hot"]
    assert got["hot"].p50 == statistics.median(hot)
    assert (got["one"].p50, got["one"].p90) == (4.0, 4.0)
    assert got["two"].p50 == 1.5 and abs(got["two"].p90 - 1.9) < 1e-12
    idx = {r.g: r.p90 for r in order.exact_percentiles(df, ["g"], "x", {"p90": 90}, "index").collect()}
    assert idx["hot"] == sorted(hot)[int(0.9 * len(hot))]
    assert idx["one"] == 4.0


def test_percentiles_of_a_narrow_hot_range(spark):
    """One group of 60,000 rows, 90 % of them in a range of one millionth, and repeated ends."""
    x = F.when(F.col("id") % 10 > 0, 1e9 + (F.col("id") * 7919 % 60007) / 100.0).otherwise(F.col("id") % 7 - 3.0)
    df = spark.range(60_000).select(F.when(F.col("id") % 600 > 0, "hot").alias("g"), x.alias("x"))
    ps = {"low": 0, "p1": 1, "p10": 10, "p50": 50, "p999": 99.9, "top": 100}
    got = {r.g: r for r in order.exact_percentiles(df, ["g"], "x", ps).collect()}
    idx = {r.g: r for r in order.exact_percentiles(df, ["g"], "x", ps, "index").collect()}
    for g, part in df.toPandas().groupby(df.toPandas().g.fillna("")):
        xs = sorted(part.x)
        for name, p in ps.items():
            rank = (len(xs) - 1) * p / 100
            a, b = xs[int(rank)], xs[min(int(rank) + 1, len(xs) - 1)]
            assert abs(got[g or None][name] - (a + (b - a) * (rank - int(rank)))) < 1e-6, (g, name)
            assert idx[g or None][name] == xs[min(int(len(xs) * p / 100), len(xs) - 1)], (g, name)


def test_percentiles_sort_little(spark):
    """Of a large group only the values around the wanted ranks are counted one by one."""
    df = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("x"))
    plan = order.exact_percentiles(df, [], "x", {"p50": 50})
    want = sorted(i * 7919 % 400_009 for i in range(400_000))
    assert plan.collect()[0].p50 == (want[199_999] + want[200_000]) / 2
    kept = order.around_ranks(df.select(F.struct(F.lit(0)).alias("_g"), F.col("x").cast("double").alias("_x")), [0.5])
    assert kept.where("_p.x IS NOT NULL").count() < 500 and kept.agg(F.sum("_c")).first()[0] == 400_000
    assert order.exact_percentiles(df.where("x < 0"), ["x"], "x", {"p50": 50}).count() == 0


def test_numbered_with_one_common_prefix(spark):
    label = F.concat(F.lit("the-same-long-prefix-"), F.format_string("%05d", F.col("id") * 7919 % 20011))
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").alias("g"), label.alias("label"))
    want = df.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy(F.desc("label"))))
    got = order.numbered(df, ["g"], [F.desc("label")])
    both = got.join(want.select("label", "want"), "label")
    assert both.count() == 20_000 and both.where("rn <> want").count() == 0
    # A fixed number of ranges, as so few bytes would be put together again.
    ranges = df.repartitionByRange(8, "g", F.desc("label")).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in ranges.collect()) < 2 * 20_000 / 8
    assert order.numbered(df.limit(0), [], [F.col("label")]).count() == 0


def test_first_seen_and_most_common(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, pos int, v string")
    assert sorted(map(tuple, order.first_seen(df, ["k"], ["pos"]).collect())) == [("a", 1, "y"), ("b", 2, "z")]
    assert [tuple(r) for r in order.most_common(df, ["k"], 1).collect()] == [("a", 2)]


def test_seeded_order_is_stable(spark):
    df = spark.range(200)
    a = [r.id for r in order.seeded_order(df, ["id"], 1).collect()]
    b = [r.id for r in order.seeded_order(df.repartition(7), ["id"], 1).collect()]
    c = [r.id for r in order.seeded_order(df, ["id"], 2).collect()]
    assert a == b != c and sorted(a) == list(range(200))


def test_within_rank_equals_ranking(spark):
    """Thresholds give the same rows as ranking every row, for cuts of 0, some and all."""
    df = skewed(spark)
    cuts = {
        "none": lambda n: F.lit(0),
        "some": lambda n: F.floor(n * F.lit(0.37)),
        "one": lambda n: F.least(n, F.lit(1)),
        "all": lambda n: n,
    }
    got = order.within_rank(df, ["g"], ["id"], 7, cuts)
    rank = order.ranked(df, ["g"], ["id"], 7, "rn", "n").select("id", "rn", "n")
    both = got.join(rank, "id")
    assert both.count() == 3000
    wrong = both.where(
        "none OR NOT all OR some <> (rn <= floor(n * 0.37D)) OR one <> (rn = 1)"
    )
    assert wrong.count() == 0
