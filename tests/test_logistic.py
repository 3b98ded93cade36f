"""Logistic regression in blocks against that of ``pyspark.ml``, and what reaches the driver."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.sql import functions as F

from uttermark.operators import logistic
from uttermark.operators.classify import intent_sweep_logreg


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)]

    def row(i):
        c = r.choice(["a", "a", "b", "c", None])
        at = {"a": 0, "b": 15, "c": 30, None: 45}[c]
        toks = [r.choice(words[at : at + 60] if r.random() < 0.35 else words) for _ in range(r.randint(0, 12))]
        cells = ["all"] + (["half"] if i % 2 else []) + (["two"] if c in ("a", None) else []) + (["one"] if c == "b" else [])
        return cells, c, toks

    schema = "cells array<string>, class string, tokens array<string>"
    rows = [row(i) for i in range(500)] + [(["two"], "a", ["only"])]
    test = [row(i)[1:] for i in range(200)] + [("unseen", ["w1"]), ("a", ["no such word"])]
    return (
        spark.createDataFrame(rows, schema).repartition(3).cache(),
        spark.createDataFrame(test, "class string, tokens array<string>").cache(),
    )


def by_library(train, test, cell):
    rows = train.where(F.array_contains("cells", cell))
    model = Pipeline(
        stages=[
            StringIndexer(inputCol="class", outputCol="_y", handleInvalid="keep"),
            CountVectorizer(inputCol="tokens", outputCol="_x", vocabSize=(1 << 31) - 1),
            LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01),
        ]
    ).fit(rows)
    ok = model.transform(test).withColumn("_ok", (F.col("prediction") == F.col("_y")).cast("int"))
    return (cell, *ok.agg(F.count(F.lit(1)), F.sum("_ok"), F.avg("_ok")).first()), model.stages[-1].summary.objectiveHistory


def test_cells_are_fitted_as_the_library_fits_them(tables, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK", 64)  # several blocks of documents
    seen, step = [], logistic._step

    def watched(state, words, cells, points, blocks):
        out = step(state, words, cells, points, blocks)
        seen.append(out[1])
        return out

    monkeypatch.setattr(logistic, "_step", watched)
    names = ["all", "half", "two", "one"]
    got = {r.cell: tuple(r) for r in intent_sweep_logreg(*tables, names).collect()}
    sizes = {c: tables[0].where(F.array_contains("cells", c)).count() for c in names}
    for i, cell in enumerate(names):
        if cell == "one":  # the library answers with the class that it has not seen
            assert got[cell][1:3] == (202, tables[1].where("class = 'b'").count())
            continue
        want, history = by_library(*tables, cell)
        assert got[cell][:3] == want[:3] and got[cell][3] == pytest.approx(want[3])
        # The objective starts with the mean loss, before any weights.
        assert seen[0][i] / sizes[cell] == pytest.approx(history[0], rel=1e-9)


def test_no_word_comes_to_the_driver(tables, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, collect = [], DataFrame.collect

    def watched(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", watched)
    monkeypatch.setattr(logistic, "STEPS", 4)
    intent_sweep_logreg(*tables, ["all", "half"]).collect()
    assert len(sizes) > 4 and max(sizes) < 60  # fewer than the 120 words, each in eight columns


def test_a_cell_without_rows_is_refused(tables):
    with pytest.raises(ValueError, match="nothing"):
        intent_sweep_logreg(*tables, ["all", "nothing"])


def test_words_are_stored_in_few_bytes(spark):
    r = random.Random(8)
    rows = [(i, "ab"[i % 2], [True], False, [f"word{int(r.paretovariate(0.7))}" for _ in range(100)]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "_no long, class string, member array<boolean>, test boolean, tokens array<string>")
    cells = logistic.Cells([{"a": 500, "b": 500}])
    stored = logistic._word_blocks(docs.repartition(1).sortWithinPartitions("_no"), cells, 2).where("b IS NOT NULL").collect()
    entries = sum(len(set(row[-1])) for row in rows)
    assert sum(len(x.place) + len(x.word) + len(x.n) for x in stored) < 6 * entries  # 16 unpacked


def test_many_blocks_of_words_share_few_shelves(tables, monkeypatch):
    names = ["all", "half", "two"]
    monkeypatch.setattr(logistic, "STEPS", 3)
    monkeypatch.setattr(logistic, "BLOCK", 64)
    want = intent_sweep_logreg(*tables, names).collect()
    monkeypatch.setattr(logistic, "WORDS", 100)
    sent, gradient = [], logistic._step

    def watched(state, words, cells, points, blocks):
        sent.append((blocks, words.select("g").distinct().count()))
        return gradient(state, words, cells, points, blocks)

    monkeypatch.setattr(logistic, "_step", watched)
    assert sorted(intent_sweep_logreg(*tables, names).collect()) == sorted(want)
    assert all(blocks > 30 and shelves <= max(8, -(-blocks // logistic.SHELF)) for blocks, shelves in sent)
