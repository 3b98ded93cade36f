"""Mixing, personal data, nearest neighbours and the pipeline."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, docs, empty
from uttermark.llm import hnsw, mixing, pii

SF = "/root/testdata/sf0.001"


def filled(sizes, share=1.5, most=2.0):
    """Targets by pouring again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        poured = left
        for s in list(open_):
            give = min(poured * w[s] / total, most * sizes[s] - target[s])
            target[s] += give
            left -= give
            if target[s] >= most * sizes[s] - 1e-9:
                open_.discard(s)
    return target


def test_targets_and_sizes(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(600):
        s = [None, "a", "b", "ä", "Z", "c"][min(5, int(r.exponential(1.5)))]
        rows.append((i, " ".join(["w"] * int(r.integers(0, 50))), "en", s, 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.taken(d).collect()
    sizes = {}
    for x in got:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        assert x["size"] == len(rows[x["doc_id"]][1].split())
        assert x["taken"] in (0, x["size"], 2 * x["size"])
    want = filled(sizes)
    for s in sizes:
        mine = [x for x in got if x["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(x["taken"] for x in mine) - want[s]) <= 25
    again = {(x["doc_id"], x["taken"]) for x in mixing.taken(d.repartition(7)).collect()}
    assert again == {(x["doc_id"], x["taken"]) for x in got}
    times = {x["doc_id"]: x["n"] for x in mixing.mixed(d).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert times == {x["doc_id"]: x["copies"] for x in got if x["copies"]}


def test_mix_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.MIX_SQL).fetchall())
    d = mixing.taken(spark.read.parquet(f"{SF}/documents.parquet")).drop("source", "copies")
    assert sorted(tuple(x) for x in d.collect()) == want


def test_heavier_rows_come_first(spark):
    d = spark.range(4000).select(
        F.col("id").cast("string").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.2).alias("w")
    )
    first = d.orderBy(mixing.exponential_key(F.col("k"), F.col("w"), "s")).limit(400)
    assert first.where("w = 1").count() == pytest.approx(400 * 5 / 6, abs=40)


def test_mix_of_awkward_rows(spark):
    d = awkward(spark)
    rows = mixing.taken(d).collect()
    assert len(rows) == d.count() and all(x["taken"] <= 2 * x["size"] for x in rows)
    assert mixing.mixed(d).columns == d.columns
    assert mixing.taken(empty(spark)).count() == 0 and mixing.mixed(empty(spark)).count() == 0


def base_spans(t):
    # The strict patterns of the contract.
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for i, (k, p) in enumerate(patterns.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card":
                total = sum(int(c) if j % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for j, c in enumerate(reversed(d)))
                if not 14 <= len(d) <= 19 or total % 10:
                    continue
            if k == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{a}:{b}" for a, i, b, k in sorted(out))


def test_base_spans_are_those_of_plain_patterns(spark):
    r = np.random.default_rng(4)
    parts = ["a", "é", "🙂", "@", ".", "x@y.co", "-", " ", "1", "22", "255", "256", "1.2.3.4", "+1", "(", ")", "_", "%"]
    parts += ["4111111111111111", "4111 1111 1111 1111", "+49 170 1234567", "\n", "00"]
    texts = ["".join(r.choice(parts, r.integers(0, 25))) for _ in range(1500)]
    texts += [None, "", "a" * 30_000 + "@b.c", "1" * 60_000, "1." * 5_000, "+" * 5_000, "a@b.c_x@y.zz-9@q.w"]
    rows = {x["doc_id"]: x for x in pii.report(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(rows[i]["spans"].split(","))
        assert sum(rows[i][f"n_{k}"] for k in pii.KINDS) == len(list(filter(None, want.split(","))))


def em_plainly(patterns, rounds):
    p = np.array([1 / (1 + math.exp(-1.5 * sum(v))) for v, n in patterns])
    n = np.array([n for _, n in patterns])
    v = np.array([v for v, _ in patterns])
    for _ in range(rounds):
        z = np.full(len(p), math.log(((n * p).sum() + 1) / ((n * (1 - p)).sum() + 1)))
        for j in range(v.shape[1]):
            for vote in (-1, 0, 1):
                at = v[:, j] == vote
                one = ((n * p)[at].sum() + 1) / ((n * p).sum() + 3)
                zero = ((n * (1 - p))[at].sum() + 1) / ((n * (1 - p)).sum() + 3)
                z[at] += math.log(one / zero)
        p = 1 / (1 + np.exp(-z))
    return p


def test_reliabilities(spark):
    r = np.random.default_rng(2)
    votes = {tuple(int(x) for x in r.choice([-1, 0, 1], pii.LABELERS, p=[0.3, 0.2, 0.5])) for _ in range(15)}
    patterns = [(list(v), float(r.integers(1, 60))) for v in sorted(votes)]
    d = spark.createDataFrame([([(v, [1.0] * pii.FEATURES, n) for v, n in patterns],)], "a array<struct<votes:array<int>,x:array<double>,n:double>>")
    got = d.select(pii.reliabilities(F.col("a"))).first()[0]
    assert got == pytest.approx(em_plainly(patterns, pii.EM_ROUNDS).tolist(), abs=1e-9)


def test_redaction_and_awkward_rows(spark):
    d = awkward(spark, [(7, "é mail a@b.co, ip 1.2.3.4 end", "en", "a", 1)])
    found = pii.redact(pii.find(d, pii.fit(d), out="found"), spans="found")
    rows = {x["doc_id"]: x for x in found.collect()}
    assert found.columns == d.columns and found.count() == d.count()
    assert rows[7]["text"] == "é mail [EMAIL], ip [IP] end" and rows[1]["text"] is None and rows[2]["text"] == ""
    assert pii.report(empty(spark)).count() == 0


def test_neighbours_against_all_distances(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(3000, 16)).astype("float32")
    x[100:400] = x[100]  # many equal vectors, more than are asked for
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (None, rows[1][1])]
    rows += [(5400, [1.0, 2.0]), rows[3]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for g in hnsw.nearest(d, shard_size=1000).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["score"], g["vec_id"]))
    assert set(got) == set(range(0, 3000, 100))  # the one vector of length two has nobody
    hits = 0
    for q, found in got.items():
        dist = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), dist)) if i != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[1:] for f in found] == sorted(f[1:] for f in found)
        assert [f[1] for f in found] == pytest.approx([dist[f[2]] for f in found])
        hits += len({f[2] for f in found} & set(order))
    assert hits >= 0.9 * 10 * len(got)
    assert [f[2] for f in sorted(got[200])] == list(range(100, 110))
    assert hnsw.nearest(d.limit(0)).count() == 0


def test_flat_graph_is_the_graph():
    r = np.random.default_rng(8)
    g = hnsw.Graph(r.normal(size=(700, 8))).build(1)
    f = hnsw.Graph.from_flat(8, **g.flat())
    for _ in range(20):
        q = r.normal(size=8)
        assert g.search(q, 10).tolist() == f.search(q, 10).tolist()


def test_pipeline(spark):
    """Each stage on its predecessor's rows; the whole against stages put together by hand."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == columns, name
        rows = d.collect()
        d = spark.createDataFrame(rows, d.schema)
        if name == "near_duplicates":
            assert len({x["doc_id"] for x in rows}) == len(rows) < n
        if name == "redact":
            assert not any(base_spans(x["text"]) for x in rows)
    last = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    want = sorted((x["doc_id"], x["ids_sha256"], x["n_tokens"]) for x in last.collect())
    got = sorted((x["doc_id"], x["ids_sha256"], x["n_tokens"]) for x in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        a = awkward(spark)
        assert stage(spark, a, SF).columns == a.columns, name
