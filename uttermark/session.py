"""Session helpers: literal tables and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs in one process a temporary
    folder is made; on a cluster a missing setting is an error, as executors could not
    read such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="uttermark-")
    return _FALLBACK[app]


def _run_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "uttermark", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing has used yet."""
    return os.path.join(_run_folder(spark), f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has put below ``scratch_path``; for the end of a run."""
    _remove(spark, _run_folder(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once and read it back from the shared folder.

    Its size in bytes is then known from the files, and Spark decides by its own
    threshold whether a join broadcasts it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._sized_at = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a table of ``sized`` that no plan in use reads any more."""
    _remove(table.sparkSession, table._sized_at)


def literal_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small dimension table as literals, so that its size is known to the optimizer.

    Only for configuration written in code (rules, language settings, templates).
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain scan over all cores when it has fewer partitions than cores.

    Only small inputs (few, unsplittable files) are ever shuffled by this; a large
    table already has more splits than cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
