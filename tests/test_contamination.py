"""Best match over all originals against every pair scored by hand."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uttermark.functions import text
from uttermark.operators import best_match, contamination, grams


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def rouge(c, o):
    a, b = re.findall("[a-z0-9]+", c.lower()), re.findall("[a-z0-9]+", o.lower())
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def bleu(c, o):
    a, b = c.split(), o.split()
    logs, k, smooth = 0.0, 0, 1.0
    for n in range(1, 5):
        ga = Counter(tuple(a[i : i + n]) for i in range(len(a) - n + 1))
        gb = Counter(tuple(b[i : i + n]) for i in range(len(b) - n + 1))
        hit, total = sum((ga & gb).values()), sum(ga.values())
        if n == 1 and hit == 0:
            return 0.0
        if total == 0:
            break
        if hit == 0:
            smooth *= 2
        logs += math.log((hit or 1 / smooth) / total)
        k = n
    bp = math.exp(1 - len(b) / len(a)) if len(a) < len(b) else 1.0
    return 100 * bp * math.exp(logs / k)


@pytest.fixture(scope="module")
def corpora(spark):
    """Short texts over few words, so most pairs share something; a third are copies."""
    rng = random.Random(11)
    words = ["the"] * 6 + ["turn", "light", "on", "off", "room", "kitchen", "red", "dim", "please", "now"]

    def make(n):
        return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(n)]

    cands = make(60) + ["the light the light on"] * 30 + ["zzz yyy"]
    origs = make(25) + ["the"]
    c = spark.createDataFrame(list(enumerate(cands)), "i int, text string")
    o = spark.createDataFrame(list(enumerate(origs)), "j int, text string")
    return cands, origs, c, o


def test_max_rouge_l(corpora):
    cands, origs, c, o = corpora
    got = {r.i: r.best for r in contamination.max_rouge_l(c, o, "text", "i").collect()}
    assert len(got) == len(cands)
    for i, t in enumerate(cands):
        assert got[i] == pytest.approx(max(rouge(t, x) for x in origs), abs=1e-9), t


def test_max_bleu4(corpora):
    cands, origs, c, o = corpora
    got = {r.i: r.best for r in contamination.max_bleu4(c, o, "text", "i").collect()}
    for i, t in enumerate(cands):
        assert got[i] == pytest.approx(max(bleu(t, x) for x in origs), abs=1e-6), t


def test_exact_match_and_jaccard(spark):
    c = spark.createDataFrame([("Turn ON!",), ("turn on",), ("off",)], "text string")
    o = spark.createDataFrame([("turn, on",), ("dim it",)], "text string")
    r = contamination.exact_match_rate(c, o, "text").first()
    assert (r.n_candidates, r.n_matches) == (3, 2) and r.match_pct == pytest.approx(200 / 3)
    j = {r.n: r for r in contamination.ngram_jaccard(c, o, "text", 3).collect()}
    assert (j[1].cand_unique, j[1].orig_unique, j[1].shared, j[1].jaccard) == (3, 4, 2, 0.4)
    assert (j[2].shared, j[2].jaccard) == (1, 0.5)
    assert (j[3].cand_unique, j[3].jaccard) == (0, 0.0)


def test_few_pairs_are_scored_and_none_that_matters_is_missed():
    rng = random.Random(3)
    zipf = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 2) for i in range(2000)]
    make = lambda n: rng.choices(zipf, weights, k=n)
    originals = [make(rng.randint(8, 60)) for _ in range(400)]
    cands = [make(rng.randint(5, 600)) for _ in range(60)]
    for i in range(0, 60, 4):
        cands[i][3:3] = originals[rng.randrange(400)]
    # Of shared words in random order only few are a common subsequence, so more pairs stay open.
    for measure, plain, share in ((best_match.RougeL, rouge, 0.3), (best_match.Bleu4, bleu, 0.1)):
        shard = best_match.Originals(originals, measure.orders)
        scored = 0
        for c in cands:
            best, n = best_match.best_in(shard, measure, c, 0.0)
            assert best == pytest.approx(max(plain(" ".join(c), " ".join(o)) for o in originals))
            assert best_match.best_in(shard, measure, c, best)[0] == best
            scored += n
        assert scored < share * len(cands) * len(originals), (measure, scored)


def test_best_match_over_many_shards_and_chunks(spark, monkeypatch):
    rng = random.Random(5)
    make = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    cands = [make(rng.randint(1, 80)) for _ in range(50)] + ["", None, "--"] + ["w1 w2 w3"] * 20
    origs = [make(rng.randint(1, 30)) for _ in range(40)] + ["", None]
    monkeypatch.setattr(best_match, "SHARD", 100)
    monkeypatch.setattr(best_match, "CHUNK", 50)
    c = spark.createDataFrame(list(enumerate(cands)), "i int, text string")
    o = spark.createDataFrame([(t,) for t in origs], "text string")
    got = {r.i: r.best for r in contamination.max_rouge_l(c, o, "text", "i").collect()}
    assert got == {i: pytest.approx(max(rouge(t or "", x or "") for x in origs)) for i, t in enumerate(cands)}
    assert {r.best for r in contamination.max_bleu4(c, o.limit(0), "text", "i").collect()} == {0.0}


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    all_ = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))


def test_ngrams_over_many_chunks_and_partitions(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(9)}" for _ in range(n))
    cands = [make(rng.randint(1, 90)) for _ in range(60)] + ["", None, "--", make(700)] + ["w1 w2 w3 w4"] * 20
    origs = [make(rng.randint(1, 30)) for _ in range(20)] + ["w1 w2 w3", None]
    monkeypatch.setattr(grams, "CHUNK", 200)
    monkeypatch.setattr(grams, "TASK", 5000)
    c, o = (spark.createDataFrame([(t,) for t in x], "text string") for x in (cands, origs))

    def brute(texts, n):
        words = [(t or "").replace("--", "").split() for t in texts]
        return {tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)}

    for r in contamination.ngram_jaccard(c, o, "text", 6).collect():
        a, b = brute(cands, r.n), brute(origs, r.n)
        assert (r.cand_unique, r.orig_unique, r.shared) == (len(a), len(b), len(a & b)), r.n
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b))
    for n in (2, 4):
        a, b = brute(cands, n), brute(origs, n)
        got = Counter(r.sides for r in contamination.ngram_sets(c, o, "text", n).collect())
        assert got == {s: k for s, k in ((1, len(a - b)), (2, len(b - a)), (3, len(a & b))) if k}
    assert contamination.ngram_sets(c.limit(0), o.limit(0), "text", 2).count() == 0
    assert {r.cand_unique for r in contamination.ngram_jaccard(c.limit(0), o, "text", 5).collect()} == {0}


def test_ngrams_of_five_orders_cost_few_bytes_a_word(spark):
    rng = random.Random(9)
    texts = [(" ".join(f"w{rng.randrange(40000)}" for _ in range(200)),) for _ in range(400)]
    c, o = spark.createDataFrame(texts, "text string"), spark.createDataFrame(texts[:3], "text string")
    before = shuffled(spark)
    assert {r.n: r.shared for r in contamination.ngram_jaccard(c, o, "text").collect()}[5] == 3 * 196
    assert shuffled(spark) - before < 60 * 200 * 400


def test_both_scores_in_one_pass_agree_and_texts_are_shuffled_twice(spark):
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) if rng.random() < 0.8 else "the" for _ in range(n))
    cands = [make(200) for _ in range(300)]
    origs = [c[:200] for c in cands[:20]] + [make(150) for _ in range(3)]
    texts = [*cands, *["A\u00a0b. ,c-\nd 5,000&amp;x-<skipped>\n(y)...", "", None]]
    c = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    o = spark.createDataFrame([(t,) for t in [*origs, "a b cd", "A b . , cd 5,000 & x ( y )"]], "text string")
    before = shuffled(spark)
    both = contamination.max_scores(c, o, "text", "i").collect()
    assert shuffled(spark) - before < 2.5 * sum(len(t or "") for t in texts)
    for name, one in (("rouge_l", contamination.max_rouge_l), ("bleu4", contamination.max_bleu4)):
        assert {r.i: r[name] for r in both} == {r.i: r.best for r in one(c, o, "text", "i").collect()}
    for column, measure in ((text.rouge_tokens, best_match.RougeL), (text.bleu13a_tokens, best_match.Bleu4)):
        want = [r.t for r in c.where("text IS NOT NULL").orderBy("i").select(column(F.col("text")).alias("t")).collect()]
        assert best_match.Texts(pa.array([t for t in texts if t is not None]), measure).lists() == want
    got = {r.i: r.rouge_l for r in both}
    long = [i for i in range(0, 300, 25)]
    assert [got[i] for i in long] == pytest.approx([max(rouge(texts[i], x) for x in origs) for i in long])
