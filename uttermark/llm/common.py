"""Helpers of the training-data operators: shared tables, words, column checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in where the setting is absent and everything runs in one
    process; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="uttermark-llm-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again.

    Later reads survive the loss of executors, the plan starts anew, and its size is known
    from the files, so that the optimizer only broadcasts what is proven small.
    """
    spark = df.sparkSession
    path = os.path.join(_run_folder(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _run_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), "uttermark-llm", spark.sparkContext.applicationId)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Remove a table of ``stored`` that no plan in use reads any more."""
    _remove(table.sparkSession, table._stored_at)


def clear_stored(spark: SparkSession) -> None:
    """Remove all that this application has stored; for the end of a run, when results are saved."""
    _remove(spark, _run_folder(spark))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def sifted(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose key may be in the only column of ``keys``, and those whose key,
    the column of that name, is not there (null keys are not).

    A bit per hash of a key tells them apart, 2^24 bits and so some megabytes at most, whatever the
    number of keys.  So a join with keys that are too many to broadcast shuffles the first rows alone.
    """
    (key,) = keys.columns
    cell, bits = fresh(rows, "_cell", "_bits")
    h = F.xxhash64(key)
    place = F.shiftrightunsigned(h, 58).cast("int")
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    marks = keys.where(F.col(key).isNotNull()).groupBy(F.pmod(h, F.lit(1 << 18)).alias(cell)).agg(F.bit_or(mark).alias(bits))
    both = rows.withColumn(cell, F.pmod(h, F.lit(1 << 18))).join(F.broadcast(stored(marks, "marks")), cell, "left")
    hit = F.col(key).isNotNull() & (F.coalesce(F.getbit(bits, place), F.lit(0)) == 1)
    return both.where(hit).drop(cell, bits), both.where(~hit).drop(cell, bits)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names near the wanted ones that the table does not have yet."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out
