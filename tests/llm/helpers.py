"""Small tables with the awkward rows: nulls, empty and long texts, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en", source="s"):
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def awkward(spark, more=()):
    """Nulls in every column, a repeated row, a very long text, extra columns with likely names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (None, "a text without an id", None, None, 20),
        (3, " \n\t ", None, "b", 4),
        (4, long, "de", None, len(long)),
        (5, "twice the same row", "en", "a", 18),
        (5, "twice the same row", "en", "a", 18),
        *more,
    ]
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA)
    names = "size ids decoded n_tokens n_words kept spans target node bands rid place x unit cell score".split()
    return d.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
