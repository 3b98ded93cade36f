"""Readers for the corpus formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from uttermark.functions.tags import align_tags, split_tags
from uttermark.functions.text import space_tokens
from uttermark.functions.util import let
from uttermark.operators.order import running
from uttermark.session import sized
from uttermark.sources.files import located

LINES = 100_000  # lines that one task orders at a time


def numbered_lines(spark: SparkSession, path: str, drop_blank: bool = False) -> DataFrame:
    """``file, line_no, value`` of text files of any size.

    A large file is read in blocks by many tasks; the lines are counted per cell of a block
    and the counts give each cell the number of its first line.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        F.rtrim("value").alias("value"),
    )
    if drop_blank:
        raw = raw.where(F.trim("value") != "")
    cell = F.struct("_block", F.expr(f"_place div {LINES}"))
    out = running(raw, ["file"], [F.col("_place")], cell, cum="line_no")
    return out.select("file", "line_no", "value")


KINDS = r"(kind=)?(seq\.in|seq\.out|label)"  # file or folder names of the three parts


def read_bio(spark: SparkSession, path: str, blank: str = "drop") -> DataFrame:
    """``unit, line_no, tokens, tags, intent`` from aligned files seq.in, seq.out, label.

    Lines are matched by number inside their unit (the folder, and the part for a folder
    written in parts).  ``blank='drop'`` removes blank lines of each file before counting;
    ``'keep'`` counts them, stops at the shortest file and drops rows blank in all three.
    """
    lines = numbered_lines(spark, path, drop_blank=blank == "drop")
    kind = F.regexp_extract("file", r"(?:/|kind=)(seq\.in|seq\.out|label)(?:/|$|\.)", 1)
    unit = F.regexp_replace("file", KINDS, "")
    rows = lines.select(unit.alias("unit"), kind.alias("kind"), "line_no", "value")

    def part(name: str) -> Column:
        return F.max(F.when(F.col("kind") == name, F.col("value"))).alias(name.replace(".", "_"))

    wide = rows.groupBy("unit", "line_no").agg(part("seq.in"), part("seq.out"), part("label"))
    wide = wide.where("seq_in IS NOT NULL AND seq_out IS NOT NULL AND label IS NOT NULL")
    wide = wide.where("trim(concat(seq_in, seq_out, label)) <> ''")
    tokens = space_tokens(F.col("seq_in"))
    return wide.select(
        "unit",
        "line_no",
        tokens.alias("tokens"),
        align_tags(tokens, split_tags(F.col("seq_out"))).alias("tags"),
        F.trim("label").alias("intent"),
    )


ICSL = "u_id string, utterance string, slot_labels string, intent string"


def read_icsl_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated intent and slot table."""
    return spark.read.csv(path, sep="\t", header=True, schema=ICSL, mode="FAILFAST", quote="")


_CHUNK = "struct<text:string,slot_name:string,entity:string>"
NESTED = (
    f"language string, intents map<string,struct<utterances:array<struct<data:array<{_CHUNK}>>>>>, "
    "entities map<string,struct<data:array<struct<value:string,synonyms:array<string>>>>>"
)


def read_nested_nlu(
    spark: SparkSession, path: str, rebuild: str = "space", multi_line: bool = True
) -> DataFrame:
    """One row per utterance: ``file, intent, utt_no, text, chunks``.

    The text is rebuilt from its chunks joined by a space (``space``), as they stand
    (``concat``), or token by token (``tokens``).  A file with ``multi_line`` is one
    document and one task; large corpora come as one document per line.
    """
    doc = spark.read.json(path, schema=NESTED, multiLine=multi_line, mode="FAILFAST")
    doc = doc.select(F.col("_metadata.file_path").alias("file"), "language", "intents")
    utts = doc.select("file", "language", F.explode("intents").alias("intent", "v"))
    utts = utts.select(
        "file", "language", "intent", F.posexplode("v.utterances").alias("utt_no", "u")
    )
    chunks = F.col("u.data")
    texts = F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit("")))
    if rebuild == "tokens":
        text = F.array_join(F.flatten(F.transform(texts, space_tokens)), " ")
    else:
        text = F.trim(F.array_join(texts, " " if rebuild == "space" else ""))
    return utts.select("file", "language", "intent", "utt_no", text.alias("text"), chunks.alias("chunks"))


def read_entities(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Gazetteers of nested documents: ``entity, pos, value, synonyms``."""
    doc = spark.read.json(path, schema=NESTED, multiLine=multi_line, mode="FAILFAST")
    e = doc.select(F.explode("entities").alias("entity", "v"))
    e = e.select("entity", F.posexplode("v.data").alias("pos", "d"))
    return e.select("entity", "pos", "d.value", "d.synonyms")


def json_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, element_no, value``: the elements of JSON arrays as text, each file read by many tasks.

    A file is cut at its commas, in cells.  What a piece does to the state of a reader is known
    without the text before it: how many quotes it has, and which brackets it opens or closes if it
    starts inside a string or outside.  Sums inside a cell are taken for both cases at once, so sums
    over the cells before, which are few, give each piece its state, and commas between elements are
    told from all others; only the pieces of one element are put together.  A file that is one object
    is one element; empty files and arrays have none.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        "value",
    )
    place, cell = F.struct("_block", "_place"), F.struct("_block", F.expr(f"_place div {LINES}"))

    def change(parts: Column, odd: int) -> Column:
        bare = F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
        return (F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))).cast("bigint")

    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no pair of backslash and letter spans a comma
    numbers = let(
        F.split(bare, '"', -1),
        lambda p: F.struct((F.size(p) - 1).cast("bigint").alias("_quotes"), change(p, 0).alias("_even"), change(p, 1).alias("_odd")),
    )
    inside = W.partitionBy("file", cell).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    d = raw.withColumn("_new", numbers).select("file", "_block", "_place", "value", "_new.*")
    d = d.withColumn("_q", F.sum("_quotes").over(inside))
    flip = (F.col("_q") - F.col("_quotes")) % 2 == 1  # the piece starts in the state that the cell does not start in
    d = d.withColumn("_out", F.when(flip, F.col("_odd")).otherwise(F.col("_even")))
    d = d.withColumn("_in", F.when(flip, F.col("_even")).otherwise(F.col("_odd")))
    d = d.withColumns({"_out": F.sum("_out").over(inside), "_in": F.sum("_in").over(inside)})
    d = sized(d.drop("_quotes", "_even", "_odd"), "json-pieces")

    cells = d.groupBy("file", cell.alias("_cell")).agg(*[F.max_by(c, "_place").alias(c) for c in ("_q", "_out", "_in")])
    before = W.partitionBy("file").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_inside", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 1)
    ends = F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out"))
    cells = cells.select("file", "_cell", "_inside", F.coalesce(F.sum(ends).over(before), F.lit(0)).alias("_above"))
    first = F.min_by(F.regexp_replace("value", r"^[\s\uFEFF]+", ""), place)
    kinds = d.groupBy("file").agg(first.startswith("[").alias("_array"))
    cells = sized(cells.join(kinds, "file"), "json-cells")

    d = d.withColumn("_cell", cell).join(cells, ["file", "_cell"]).drop("_cell")
    d = d.withColumn("_depth", F.col("_above") + F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")))
    closed = (F.col("_q") + F.col("_inside").cast("int")) % 2 == 0
    between = F.when(F.col("_array") & (F.col("_depth") == 1) & closed, 1).otherwise(0)
    d = d.select("file", "_block", "_place", "value", "_array", "_depth", between.cast("bigint").alias("_between"))
    d = running(d, ["file"], [F.col("_place")], cell, F.col("_between"), cum="_n")
    d = d.groupBy("file", (F.col("_n") - F.col("_between")).alias("element_no"), "_array").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_place", "value"))).alias("p"), F.min("_depth").alias("_least")
    )
    text = F.array_join("p.value", ",")
    text = F.when(F.col("_array") & (F.col("element_no") == 0), F.regexp_replace(text, r"^[\s\uFEFF]*\[", "")).otherwise(text)
    text = F.when(F.col("_array") & (F.col("_least") == 0), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return d.select("file", "element_no", F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("value")).where("value <> ''")


def read_json_records(
    spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True
) -> DataFrame:
    """Records of JSON arrays (or, without ``multi_line``, one per line).

    An array may be of any size and on any number of lines: see ``json_elements``.
    """
    if not multi_line:
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    parsed = F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")
    return json_elements(spark, path).select(parsed).select("r.*")


def read_parquet_cols(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """Named columns of all files of a glob; only those columns are read."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths).select(*columns)


def read_csv_records(spark: SparkSession, path: str, schema: str, required: list[str] = ()) -> DataFrame:
    """CSV with a header; ``bad`` marks rows that do not fit the schema or lack a required
    value, so that they can be skipped and counted."""
    full = f"{schema}, _broken string"
    df = spark.read.csv(
        path, header=True, schema=full, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken",
        enforceSchema=True, escape='"',
    )
    bad = F.col("_broken").isNotNull()
    for c in required:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return df.withColumn("bad", bad).drop("_broken")


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``file, sent_no, tokens, gold, pred`` from ``word gold pred`` lines.

    A blank line ends a sentence; a line of fewer than three fields is passed over.  The sentence number is the running count of blank lines,
    computed in pieces of a file; only the lines of one sentence are ever put together.
    """
    lines = numbered_lines(spark, path)
    blank = F.when(F.trim("value") == "", 1).otherwise(0).cast("bigint")
    lines = running(
        lines, ["file"], [F.col("line_no")], F.expr(f"line_no div {LINES}"), blank, cum="sent_no"
    )
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.size(parts) >= 3).select(
        "file", "sent_no", "line_no",
        F.get(parts, F.lit(0)).alias("word"),
        F.get(parts, F.lit(1)).alias("gold"),
        F.get(parts, F.lit(2)).alias("pred"),
    )
    sent = rows.groupBy("file", "sent_no").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "word", "gold", "pred"))).alias("r")
    )
    return sent.select(
        "file", "sent_no",
        F.col("r.word").alias("tokens"), F.col("r.gold").alias("gold"), F.col("r.pred").alias("pred"),
    )


FIRST = 4096  # bytes of a file read at once; most headers end before


class _Ranges:
    """Byte ranges of one file: the first block is kept, later ones are read as asked for."""

    def __init__(self, f):
        self.f = f
        self.first = f.read_at(FIRST, 0)

    def __call__(self, at: int, n: int) -> bytes:
        return self.first[at : at + n] if at + n <= len(self.first) else self.f.read_at(n, at)


def _header(read: _Ranges, size: int) -> tuple | None:
    """The numbers of a RIFF file, from chunk to chunk up to the data; only headers are read."""
    if size < 44 or read(0, 4) != b"RIFF" or read(8, 4) != b"WAVE":
        return None
    fmt = facts = None
    at = 12
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        at += 8
        if name == b"fmt " and length >= 16 and at + 16 <= size:
            fmt = struct.unpack("<HHIIHH", read(at, 16))
        elif name == b"fact" and length >= 4 and at + 4 <= size:
            (facts,) = struct.unpack("<I", read(at, 4))
        elif name == b"data":
            if fmt is None:
                return None
            tag, channels, rate, _, frame_bytes, bits = fmt
            if tag not in (1, 3, 6, 7, 0xFFFE):  # compressed in blocks: the frames are those of the fact chunk
                if facts is None:
                    return None
                length = facts * frame_bytes
            return channels, rate, frame_bytes, bits, length
        at += length + length % 2
    return None


_NUMBERS = ("channels", "rate", "frame_bytes", "bits", "bytes")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``path, size`` to the numbers of each file's header, null where it has none."""
    for b in batches:
        paths, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
        found = []
        for path, size in zip(paths, sizes, strict=True):
            fs, name = located(path)
            with fs.open_input_file(name) as f:
                found.append(_header(_Ranges(f), size) or (None,) * len(_NUMBERS))
        numbers = [pa.array([h[i] for h in found], pa.int64()) for i in range(len(_NUMBERS))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *numbers], ["path", "size", *_NUMBERS])


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``file, size, valid, channels, sample_width, sample_rate, n_frames, duration``.

    Spark lists the files (without their content, so a file may be of any size); the tasks
    read ranges of bytes, from one chunk header to the next up to the data.  Files that are
    no RIFF audio, or have no data chunk after their format, are not valid.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("length").alias("size"))
    )
    # A scan gives a task only a few files, as if they were read whole; headers need far fewer tasks.
    listed = listed.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "path string, size bigint, " + ", ".join(f"{n} bigint" for n in _NUMBERS)
    head = F.struct(*_NUMBERS).alias("h")
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    d = listed.mapInArrow(_headers, schema).select(name, "size", head)
    valid = F.coalesce((F.col("h.rate") > 0) & (F.col("h.frame_bytes") > 0), F.lit(False))
    d = d.withColumn("valid", valid)
    frames = F.when(F.col("valid"), F.expr("h.bytes div h.frame_bytes"))
    return d.select(
        "file", "size", "valid",
        F.when(F.col("valid"), F.col("h.channels")).cast("int").alias("channels"),
        F.when(F.col("valid"), F.expr("h.bits div 8")).cast("int").alias("sample_width"),
        F.when(F.col("valid"), F.col("h.rate")).cast("int").alias("sample_rate"),
        frames.alias("n_frames"),
        F.when(F.col("valid"), frames / F.col("h.rate")).alias("duration"),
    )
