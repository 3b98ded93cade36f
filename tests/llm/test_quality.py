"""Base rules and the outlier rule against plain numpy; the attention classifier."""

import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward, docs, empty
from uttermark.llm import mcd, mil


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(words), sum(map(len, words)), symbols, sum(n - 1 for n in Counter(lines).values()), len(hit)]


def test_base_counts():
    r = np.random.default_rng(1)
    parts = ["a", "bé", "#*", "中", " ", " ", "\n", "\t", "same line\n", "\x0b", "\x1c", "x y z "]
    for _ in range(400):
        t = "".join(r.choice(parts, r.integers(0, 60)))
        assert mcd.text_counts(t)[0] == plain_counts(t)
    assert mcd.text_counts(None)[0] == [0] * 5


def floored(c):
    return c + np.diag(np.maximum(mcd.LEAST**2 - np.diag(c), 0) + 0.01 * mcd.LEAST**2)


def brute_mcd(x, rounds=60):
    """Concentration from many random starts on one group, without cells."""
    h, best = int(np.ceil(mcd.KEEP * len(x))), None
    r = np.random.default_rng(0)
    for _ in range(20):
        pick = r.choice(len(x), mcd.P + 1, replace=False)
        for _ in range(rounds):
            m = x[pick].mean(0)
            c = floored(np.cov(x[pick].T, bias=True) * mcd.consistency(mcd.KEEP))
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(pick):
                break
            pick = new
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = (det, m, c)
    _, m, c = best
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    near = x[d <= mcd.solve(lambda v: mcd.chi2_cdf(v, mcd.P), mcd.WEIGHT_AT, 0, 500)]
    c = floored(np.cov(near.T, bias=True) * mcd.consistency(mcd.WEIGHT_AT))
    m = near.mean(0)
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def test_outliers_are_those_of_a_plain_estimate(spark):
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choice(words, 120)) for _ in range(220)]
    texts += [t + " " + " ".join(w + "$$$&&&" for w in r.choice(words, 120)) for t in texts[:25]]
    texts += [" ".join(w.upper() + "!!" for w in r.choice(words, 100)) for _ in range(20)]
    got = {g["doc_id"]: g["kept"] for g in mcd.judge(docs(spark, texts)).collect()}
    x = np.array([mcd.text_counts(t)[1] for t in texts])
    want = brute_mcd(x) <= mcd.CUT
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert want[:220].all() and not want[220:].any()


def test_chi_square():
    assert mcd.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert mcd.chi2_tail(12.5916, 6) == pytest.approx(0.05, abs=1e-5)


def test_rules_on_awkward_rows(spark):
    d = awkward(spark)
    rows = mcd.judge(d).collect()
    assert len(rows) == d.count()
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 50)
    good = mcd.keep_good(d)
    assert good.columns == d.columns and {r["doc_id"] for r in good.collect()} <= {4}
    assert mcd.judge(empty(spark)).count() == 0 and mcd.keep_good(empty(spark)).count() == 0


def test_small_groups_are_pooled(spark):
    texts = [" ".join(f"w{(i * 7 + j * j) % 400}" for j in range(70)) for i in range(60)]
    d = docs(spark, texts).selectExpr("doc_id", "text", "lang", "concat('s', doc_id % 20) source", "n_chars")
    rows = d.selectExpr("lang", "source")
    assert {r["unit"][:1] for r in mcd.units(rows, "lang", "source").collect()} == {"1"}
    assert mcd.judge(d).where("kept").count() == 60


def test_attention_gradient():
    r = np.random.default_rng(3)
    bags = [r.normal(size=(n, mil.WIDTH)) for n in (1, 4, 7)]
    x, starts, y = np.vstack(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    m = mil.Model()

    def loss():
        z, _ = m.forward(x, starts)
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    g = m.gradient(x, starts, y)
    for k, w in m.w.items():
        at = tuple(0 for _ in w.shape)
        old = w[at]
        w[at] = old + 1e-6
        up = loss()
        w[at] = old - 1e-6
        down = loss()
        w[at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-8)


def test_one_bad_passage_decides(spark):
    r = np.random.default_rng(9)
    clean = lambda n: " ".join("".join(r.choice(list("abcdef"), 5)) for _ in range(n))
    texts, y = [], []
    for i in range(400):
        t = clean(200)
        if i % 3 == 0:
            t += " " + " ".join("".join(r.choice(list("abcdef"), 5)) + "%%%" for _ in range(60))
        texts.append(t)
        y.append(int(i % 3 != 0))
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    rows = mil.score(d, mil.fit(d, labels)).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40
    assert np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.97


def test_scores_of_awkward_rows(spark):
    d = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mil.score(d, mil.fit(d, none)).collect()
    assert len(rows) == d.count() and all(0 <= r["score"] <= 1 for r in rows)
    nulls = spark.createDataFrame([(4, 1, None), (4, 0, 1), (2, None, 1), (None, 1, 1), (5, 1, 0)], none.schema)
    assert mil.score(empty(spark), mil.fit(d, nulls)).count() == 0
