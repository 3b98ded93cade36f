"""Round trips: rows derived from the tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from uttermark.plans.aggregates import CORPUS_SQL, corpus
from uttermark.plans.bio import CHUNKS_SQL, chunked
from uttermark.plans.registry import TAGGED_SQL, query
from uttermark.session import scratch_path
from uttermark.sources import readers, writers

BIO_OUT = "array_to_string(tokens, ' ') AS tokens, array_to_string(tags, ' ') AS tags, lower(intent) AS intent"


def _written_corpus(t):
    out = scratch_path(t.spark, "bio")
    writers.write_bio(corpus(t).withColumnRenamed("utt_id", "row_id"), out)
    return out


def _flat(df):
    return df.select(
        F.array_join("tokens", " ").alias("tokens"), F.array_join("tags", " ").alias("tags"), "intent"
    )


@query("a1_read_bio", f"WITH {CORPUS_SQL} SELECT {BIO_OUT} FROM corpus WHERE len(tokens) > 0")
def a1(t):
    return _flat(readers.read_bio(t.spark, _written_corpus(t), blank="keep"))


@query(
    "a10_write_bio",
    f"""WITH {CORPUS_SQL} SELECT lang, split, count(*) AS n, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM corpus WHERE len(tokens) > 0 GROUP BY 1, 2""",
)
def a10(t):
    d = readers.read_bio(t.spark, _written_corpus(t))
    d = d.select(
        F.regexp_extract("unit", "lang=([^/]+)", 1).alias("lang"),
        F.regexp_extract("unit", "split=([^/]+)", 1).alias("split"),
        F.size("tokens").alias("k"),
    )
    return d.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("n_tokens"))


@query(
    "a2_read_icsl_tsv",
    f"""WITH {TAGGED_SQL} SELECT utt_id AS u_id, array_to_string(tokens, ' ') AS utterance, array_to_string(gold, ' ') AS slot_labels, role AS intent FROM tagged WHERE len(tokens) > 0""",
)
def a2(t):
    out = scratch_path(t.spark, "icsl")
    rows = t.tagged.where(F.size("tokens") > 0).select(
        F.col("utt_id").alias("u_id"),
        F.array_join("tokens", " ").alias("utterance"),
        F.array_join("gold", " ").alias("slot_labels"),
        F.col("role").alias("intent"),
    )
    writers.write_icsl_tsv(rows, out)
    return readers.read_icsl_tsv(t.spark, out)


def _nested_docs(t):
    """One nested document per turn and line: an intent with one annotated utterance."""
    data = F.transform(
        "chunks",
        lambda c: F.struct(c["text"].alias("text"), c["slot_name"].alias("slot_name"), F.lit(None).cast("string").alias("entity")),
    )
    utts = F.array(F.struct(data.alias("data")))
    return chunked(t).select(
        F.col("utt_id").alias("language"),
        F.create_map(F.col("role"), F.struct(utts.alias("utterances"))).alias("intents"),
    )


@query(
    "a3_read_nested_nlu",
    f"""WITH {CHUNKS_SQL}, j AS (SELECT utt_id, string_agg(text, '' ORDER BY cid) AS c, string_agg(text, ' ' ORDER BY cid) AS s FROM chunks GROUP BY 1)
SELECT utt_id, role AS intent, trim(coalesce(c, '')) AS concat_text, trim(coalesce(s, '')) AS space_text, array_to_string(tokens, ' ') AS token_text FROM tagged LEFT JOIN j USING (utt_id)""",
)
def a3(t):
    """The three ways to rebuild a text from its chunks."""
    out = scratch_path(t.spark, "nested")
    writers.write_report(_nested_docs(t), out, "json")

    def texts(how, name):
        d = readers.read_nested_nlu(t.spark, out, how, multi_line=False)
        return d.select(F.col("language").alias("utt_id"), "intent", F.col("text").alias(name))

    d = texts("concat", "concat_text")
    d = d.join(texts("space", "space_text").drop("intent"), "utt_id")
    return d.join(texts("tokens", "token_text").drop("intent"), "utt_id")


RECORDS = "event_id bigint, event_type string, value double, props string"


@query("a4_read_json_records", "SELECT event_id, event_type, value, props FROM events")
def a4(t):
    out = scratch_path(t.spark, "records")
    writers.write_report(t.events.select("event_id", "event_type", "value", "props"), out, "json")
    return readers.read_json_records(t.spark, out, RECORDS, multi_line=False)


@query("a4_read_json_array", "SELECT event_id, event_type, value, props FROM events")
def a4_array(t):
    """One array for each type of event, its records separated by commas in one file."""
    out = scratch_path(t.spark, "arrays")
    record = F.to_json(F.struct("event_id", "event_type", "value", "props"))
    each = W.partitionBy("event_type").orderBy("event_id")  # one shuffle and sort, in which the lines stay
    first, last = F.lag(F.lit(1)).over(each).isNull(), F.lead(F.lit(1)).over(each).isNull()
    line = F.concat(F.when(first, "[\n").otherwise(" ,"), record, F.when(last, "\n]").otherwise(""))
    rows = t.events.select("event_type", line.alias("value"))
    rows.select("event_type", "value").write.partitionBy("event_type").text(out)
    return readers.read_json_records(t.spark, out, RECORDS)


@query("a5_read_parquet_cols", "SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def a5(t):
    d = readers.read_parquet_cols(t.spark, t.path("part"), ["p_type", "p_retailprice"])
    return d.groupBy("p_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price")
    )


@query(
    "a6_read_csv_records",
    """SELECT event_type, count(*) FILTER (WHERE event_id % 10 > 1) AS n_good, count(*) FILTER (WHERE event_id % 10 <= 1) AS n_bad,
  CAST(sum(event_id) FILTER (WHERE event_id % 10 > 1) AS BIGINT) AS id_sum FROM events GROUP BY 1""",
)
def a6(t):
    """Every tenth row has a number that is none, another tenth an empty command."""
    out = scratch_path(t.spark, "csv")
    kind = F.col("event_id") % 10
    rows = t.events.select(
        F.when(kind == 0, F.lit("x")).otherwise(F.col("event_id").cast("string")).alias("id"),
        F.when(kind == 1, F.lit(None)).otherwise(F.col("props")).alias("command"),
        "event_type",
    )
    writers.write_report(rows, out, "csv")
    d = readers.read_csv_records(t.spark, out, "id bigint, command string, event_type string", ["command"])
    return d.groupBy("event_type").agg(
        F.count_if(~F.col("bad")).alias("n_good"),
        F.count_if(F.col("bad")).alias("n_bad"),
        F.sum(F.when(~F.col("bad"), F.col("id"))).alias("id_sum"),
    )


@query(
    "a7_read_conll",
    f"WITH {TAGGED_SQL} SELECT array_to_string(tokens, ' ') AS tokens, array_to_string(gold, ' ') AS gold, array_to_string(pred, ' ') AS pred FROM tagged WHERE len(tokens) > 0",
)
def a7(t):
    out = scratch_path(t.spark, "conll")
    writers.write_report(t.tagged, out, "conll")
    d = readers.read_conll(t.spark, out)
    return d.select(*[F.array_join(c, " ").alias(c) for c in ("tokens", "gold", "pred")])


def _le(c, size):
    """Little-endian bytes of a number."""
    h = F.lpad(F.hex(c), size * 2, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(size * 2 - 1, 0, -2)]))


def _note(n):
    """A LIST chunk of n bytes, padded to an even number."""
    return F.concat(F.encode(F.lit("LIST"), "US-ASCII"), _le(F.lit(n), 4), F.unhex(F.lit("00" * (n + n % 2))))


def clips(t):
    """A WAV clip per turn whose samples are the bytes of the text.  Every tenth is broken; some
    have a note (its length even, or odd and padded) between format and samples."""
    data = F.encode("text", "UTF-8")
    n = F.expr("(octet_length(encode(text, 'UTF-8')) div 2) * 2").cast("bigint")
    rate = F.lit(8000) * (F.col("turn") % 2 + 1)
    kind = F.col("conv_id") % 10
    note = F.when(kind == 3, _note(10)).when(kind == 6, _note(5)).otherwise(F.unhex(F.lit("")))
    head = F.concat(
        F.encode(F.lit("RIFF"), "US-ASCII"), _le(n + 36 + F.octet_length(note), 4), F.encode(F.lit("WAVEfmt "), "US-ASCII"),
        _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2), _le(rate, 4), _le(rate * 2, 4),
        _le(F.lit(2), 2), _le(F.lit(16), 2), note, F.encode(F.lit("data"), "US-ASCII"), _le(n, 4),
    )
    wav = F.when(F.col("conv_id") % 10 == 0, data).otherwise(
        F.concat(head, F.substring(data, F.lit(1), n.cast("int")))
    )
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".wav"))
    return t.conversations.select(name.alias("file"), wav.alias("audio"), "role")


CLIP_SQL = """cl AS (SELECT 'c' || conv_id || '_' || turn || '.wav' AS file, role, conv_id % 10 <> 0 AS valid, strlen(text) AS b,
  CASE conv_id % 10 WHEN 3 THEN 62 WHEN 6 THEN 58 ELSE 44 END AS hb, 8000 * (turn % 2 + 1) AS rate FROM conversations)"""


def _written_clips(t):
    out = scratch_path(t.spark, "wav")
    writers.unpack_binary(clips(t), "audio", "file", out)
    return out


@query(
    "a8_file_inventory",
    f"""WITH {CLIP_SQL} SELECT file, CASE WHEN valid THEN hb + b // 2 * 2 ELSE b END AS size, valid, CASE WHEN valid THEN 1 END AS channels,
  CASE WHEN valid THEN 2 END AS sample_width, CASE WHEN valid THEN rate END AS sample_rate, CASE WHEN valid THEN b // 2 END AS n_frames,
  CASE WHEN valid THEN round((b // 2) / CAST(rate AS DOUBLE), 6) END AS duration FROM cl""",
)
def a8(t):
    d = readers.file_inventory(t.spark, _written_clips(t))
    return d.withColumn("duration", F.round("duration", 6))


@query(
    "a9_unpack_binary",
    f"WITH {CLIP_SQL} SELECT role, count(*) AS n_index, count(*) AS n_files, CAST(sum(CASE WHEN valid THEN hb + b // 2 * 2 ELSE b END) AS BIGINT) AS bytes FROM cl GROUP BY 1",
)
def a9(t):
    """Files against the index: every indexed clip is there with its bytes."""
    index = clips(t).select("file", "role")
    files = readers.file_inventory(t.spark, _written_clips(t)).select("file", "size")
    return index.join(files, "file", "left").groupBy("role").agg(
        F.count(F.lit(1)).alias("n_index"), F.count("size").alias("n_files"), F.sum("size").alias("bytes")
    )


@query(
    "a11_write_report",
    "SELECT '| ' || lang || ' | ' || count(*) || ' | ' || coalesce(CAST(max(CASE WHEN lang = 'en' THEN NULL ELSE n_chars END) AS VARCHAR), 'n/a') || ' |' AS line FROM documents GROUP BY lang",
)
def a11(t):
    out = scratch_path(t.spark, "report")
    d = t.documents.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("lang") != "en", F.col("n_chars"))).alias("longest")
    )
    writers.write_report(d, out, "markdown")
    return t.spark.read.text(out).withColumnRenamed("value", "line")
