"""Single files on the file system that Spark uses, read and written inside tasks."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_URI = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)$", re.S)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's own readers would complete it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a qualified path, whose name may hold any letters."""
    scheme, authority, path = _URI.match(uri).groups()
    if scheme == "file":
        return pafs.LocalFileSystem(), path
    fs, root = pafs.FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return fs, root.rstrip("/") + path


def put(fs: pafs.FileSystem, path: str, data: bytes, attempt: int) -> None:
    """Write a file that is seen only when it is whole: an attempt that dies leaves a hidden
    file of its own name, and a later one replaces what an earlier one finished."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{attempt}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)  # a local move replaces by itself
    fs.move(part, path)
