"""Writers for the corpus formats and reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from uttermark.sources.files import located, put, qualified


def write_bio(df: DataFrame, out: str, by: list[str] = ("lang", "split")) -> None:
    """Aligned text files ``<by>/kind=seq.in|seq.out|label/part-*``.

    ``df``: ``row_id, tokens, tags, intent`` and the ``by`` columns.  One task writes the
    three lines of a row into parts of the same number, in the same order, so the parts
    align line by line and nothing has to pass through a single file.
    """
    line = F.inline(
        F.array(
            F.struct(F.lit("seq.in").alias("kind"), F.array_join("tokens", " ").alias("value")),
            F.struct(F.lit("seq.out").alias("kind"), F.array_join("tags", " ").alias("value")),
            F.struct(F.lit("label").alias("kind"), F.lower("intent").alias("value")),
        )
    )
    rows = df.select(*by, "row_id", line)
    rows = rows.sortWithinPartitions(*by, "kind", "row_id").drop("row_id")
    rows.write.mode("errorifexists").partitionBy(*by, "kind").text(out)


def write_icsl_tsv(df: DataFrame, out: str) -> None:
    df.write.csv(out, sep="\t", header=True, quote="", escape="")


def write_report(df: DataFrame, out: str, fmt: str = "csv") -> None:
    """Write a result as csv, tsv, json (one object per line), conll or markdown text.

    ``conll`` expects ``tokens, gold, pred`` and writes a blank line after each sentence;
    ``markdown`` writes the body rows of a table.
    """
    if fmt in ("csv", "tsv"):
        df.write.csv(out, sep="," if fmt == "csv" else "\t", header=True)
    elif fmt == "json":
        df.write.json(out)
    elif fmt == "conll":
        df.select(conll_text().alias("value")).write.text(out)
    elif fmt == "markdown":
        cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("n/a")) for c in df.columns])
        df.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")).write.text(out)
    else:
        raise ValueError(f"unknown report format: {fmt}")


def conll_text():
    """One sentence as lines ``word gold pred`` and a blank line."""
    rows = F.zip_with(
        F.zip_with("tokens", "gold", lambda w, g: F.concat_ws(" ", w, g)),
        F.col("pred"),
        lambda a, p: F.concat_ws(" ", a, p),
    )
    return F.concat(F.array_join(rows, "\n"), F.lit("\n"))


def unpack_binary(df: DataFrame, bytes_col: str, name_col: str, out: str) -> None:
    """Write each row's bytes to its own file below ``out``.

    Runs on the executors, on the file system that Spark takes for ``out``, which they must
    share.  A file is moved to its name when it is whole, so a lost executor leaves none half
    written, and a repeated task writes the same names again.  Rows without a name or without
    bytes are left out; of equal names one stays.
    """
    root = qualified(df.sparkSession, out)

    def write(rows: Iterator[Row]) -> None:
        fs, base = located(root)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for data, name in rows:
            put(fs, f"{base}/{name}", bytes(data), attempt)

    whole = F.col(bytes_col).isNotNull() & F.col(name_col).isNotNull()
    df.where(whole).select(bytes_col, name_col).foreachPartition(write)
