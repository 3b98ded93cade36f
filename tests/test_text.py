"""Text functions on the edge cases of several scripts."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from uttermark.functions import text

SAMPLES = [
    "", "one", "Don't stop", "otobüs izmir'den geliyor", "l'entrée de l'hôtel", "दिल्ली से उड़ान", "从北京 到上海",
    "two\nlines  here", "book <number> seats with {{River Rail}} (window/aisle)", "a_b c-d 3.5% U.S. ok.", "ﬁne Ångström 𝒳",
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string")


def run(frame, col):
    return [r.v for r in frame.select("i", col.alias("v")).orderBy("i").collect()]


def test_word_and_char_tokens(frame):
    assert run(frame, text.word_tokens(F.col("t"))) == [re.findall(r"\w+(?:'\w+)?", s.lower()) for s in SAMPLES]
    assert run(frame, text.char_tokens(F.col("t"))) == [[c for c in s if c.strip()] for s in SAMPLES]
    assert run(frame, text.punct_tokens(F.col("t"))) == [re.findall(r"\w+(?:'\w+)?|[^\w\s]", s) for s in SAMPLES]


def test_ngrams(frame):
    for n in (1, 2, 3):
        want = []
        for s in SAMPLES:
            k = re.findall(r"\w+(?:'\w+)?", s.lower())
            want.append([" ".join(k[i : i + n]) for i in range(len(k) - n + 1)])
        assert run(frame, text.ngrams(text.word_tokens(F.col("t")), n)) == want


def test_contractions_fire_in_order_and_only_for_english(spark):
    df = spark.createDataFrame([("Don't  go. I'll", "en"), ("izmir'den", "tr")], "t string, lang string")
    got = [r[0] for r in df.select(text.expand_contractions(F.col("t"), F.col("lang"))).collect()]
    assert got == ["don not go i will", "izmir'den"]


def test_accents(frame):
    def bare(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()

    assert run(frame, text.strip_accents_any(F.col("t"))) == [bare(s) for s in SAMPLES]
    latin = frame.where("i IN (2, 3, 4)")
    assert run(latin, text.strip_accents(F.col("t"))) == [bare(SAMPLES[i]) for i in (2, 3, 4)]


def test_small_forms(frame):
    assert run(frame, text.strip_placeholders(F.col("t")))[8] == "book  seats with  window/aisle"
    assert run(frame, text.canonicalize(F.col("t")))[7] == "two lines here"
    assert run(frame, text.strip_suffix(text.word_tokens(F.col("t"))))[3] == ["otobüs", "izmir", "geliyor"]
    assert run(frame, text.basename(F.concat(F.lit("a\\b/"), F.col("t"))))[1] == "one"
    assert run(frame, text.opener(F.col("t")))[:2] == ["", "one"]


def test_bleu_tokens(spark):
    df = spark.createDataFrame([('He said, "3.5-4" &amp; left.\n',)], "t string")
    got = df.select(text.bleu13a_tokens(F.col("t"))).first()[0]
    assert got == ["He", "said", ",", '"', "3.5", "-", "4", '"', "&", "left", "."]
