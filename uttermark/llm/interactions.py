"""How filters interact: truth-table words and positional popcounts.

A document that fails some of k filters survives exactly the subsets that hold none of them.  Its
word has one bit for each of the 2^k subsets, set where it survives (32 bits for five filters).
How many documents survive a subset is then the number of words with that bit: a positional
popcount, taken by carry-save adders, which turn three words of one weight into a sum of that weight
and a carry of twice the weight, until few words are left whose bits are counted.

Those counts, per part and label, are all that the audit needs: any order of filters is a path
through the subsets, and what a step removes is the difference of two counts.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm.common import stored

FILTERS = "ABCDE"
MIN_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the code points
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUBSETS = 1 << len(FILTERS)
FLUSH = 10_000  # parts that one task counts before it hands on what it has

_but_capitals = bytes(set(range(256)) - set(CAPITALS))
_but_marks = bytes(set(range(256)) - set(MARKS))
_continued = bytes(range(0x80, 0xC0))  # bytes that start no code point


def own_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # at space and \t \n \v \f \r
    few = len(words) < MIN_WORDS
    repeated = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    capitals = len(text.translate(None, _but_capitals))
    loud = 100 * capitals > MOST_CAPITALS * len(text.translate(None, _continued)) if capitals else False
    marked = bool(text.translate(None, _but_marks))
    return few | repeated << 1 | loud << 2 | marked << 3


def survival_words(failures: np.ndarray) -> np.ndarray:
    """Word of each document: bit s is set if subset s holds none of the filters it fails."""
    subsets = np.arange(SUBSETS, dtype=np.int64)
    table = np.array([int(((subsets & f) == 0) @ (1 << subsets)) for f in range(SUBSETS)], dtype=np.uint32)
    return table[failures]


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts = np.zeros(32, dtype=np.int64)
    level, weight = words.astype(np.uint32), 1
    while len(level):
        carries = []
        while (n := len(level) // 3) > 0:
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        counts += weight * ((level[:, None] >> np.arange(32, dtype=np.uint32)) & 1).sum(axis=0, dtype=np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed, digest``: bits of A to D, and a digest of the whole text."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("part", docs.schema["source"].dataType),
            T.StructField("failed", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]
            failed = pa.array([own_failures(t) for t in texts], type=pa.int32())
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), failed, digest], names=schema.names)

    part = F.coalesce(F.col("source"), F.lit("")).alias("part")
    return docs.select("doc_id", part, "text").mapInArrow(run, schema)


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed`` with the bit of E: another row with a smaller id has the same text."""
    rows = stored(judged(docs), "judged")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    repeated = stored(groups.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    bit = F.when(again, 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(repeated, "digest", "left").select("doc_id", "part", F.col("failed").bitwiseOR(bit).alias("failed"))


def survivors(rows: DataFrame) -> DataFrame:
    """``part, good, toxic, counts``: how many rows of ``part, failed, good, toxic`` survive each subset."""
    schema = "part string, good boolean, toxic boolean, counts array<bigint>"

    def told(counts: dict) -> pa.RecordBatch:
        parts, good, toxic = zip(*counts, strict=True)
        kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
        cols = [parts, good, toxic, [c.tolist() for c in counts.values()]]
        arrays = [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "good", "toxic", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            labels = batch.column(2).cast(pa.int8()).to_numpy(zero_copy_only=False) * 2
            labels = labels + batch.column(3).cast(pa.int8()).to_numpy(zero_copy_only=False)
            group = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + labels
            words = survival_words(batch.column(1).to_numpy(zero_copy_only=False))
            order = np.argsort(group, kind="stable")
            keys, starts = np.unique(group[order], return_index=True)
            names = parts.dictionary.to_pylist()
            for key, of in zip(keys.tolist(), np.split(words[order], starts[1:]), strict=True):
                name = (names[key >> 2], bool(key & 2), bool(key & 1))
                counts[name] = counts.get(name, 0) + positional_popcount(of)
            if len(counts) > FLUSH:
                yield told(counts)
                counts = {}
        if counts:
            yield told(counts)

    found = rows.select("part", "failed", "good", "toxic").mapInArrow(run, schema)
    each = [F.sum(F.get("counts", F.lit(s))).alias(f"s{s}") for s in range(SUBSETS)]
    found = found.groupBy("part", "good", "toxic").agg(*each)
    return found.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(SUBSETS)]).alias("counts"))


def _walked(parts: DataFrame) -> DataFrame:
    """Each part with all orders of the filters, step by step: the subset before, and the filter."""
    orders = " ".join(map("".join, itertools.permutations(FILTERS)))
    d = parts.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [F.instr("filter_order", x) for x in FILTERS]
    before = [F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)]
    bit = [F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place)]
    return d.select("*", sum(before[1:], before[0]).alias("before"), sum(bit[1:], bit[0]).alias("bit"))


def _at(counts: str, subset: Column) -> Column:
    return F.get(counts, subset)


def _shapley(counts: str, i: int) -> Column:
    """What filter i removes, summed over all orders: the orders that have a set before it are
    counted instead of walked."""
    k, total = len(FILTERS), F.lit(0).cast("long")
    for s in range(SUBSETS):
        if not s >> i & 1:
            size = s.bit_count()
            orders = math.factorial(size) * math.factorial(k - 1 - size)
            total = total + orders * (F.get(counts, F.lit(s)) - F.get(counts, F.lit(s | 1 << i)))
    return total


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters, and step.

    ``part`` is the source (null: the empty string); null texts are empty.  A document is good or
    toxic if any row of ``labels`` with its id says so; labels without an id, and rows of documents
    without one, meet nothing.  A text repeats if a row with a smaller id has the same, so repeated
    rows with one id do not repeat each other, and rows without an id neither fail E nor make others
    fail.  Every row counts.  Without documents there are no parts and no rows.  Other columns are
    not looked at.
    """
    rows = failures(docs)
    told = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    told = told.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(told, "doc_id", "left")
    no = F.lit(False)
    rows = rows.select("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    classes = survivors(rows)

    def summed(which: Column) -> Column:
        of = [F.coalesce(F.sum(F.when(which, F.get("counts", F.lit(s)))), F.lit(0)) for s in range(SUBSETS)]
        return F.array(*of)

    parts = classes.groupBy("part").agg(
        summed(F.lit(True)).alias("n"), summed(F.col("good")).alias("g"), summed(F.col("toxic")).alias("t")
    )
    shapley = F.array(*[_shapley("n", i) for i in range(len(FILTERS))])
    parts = stored(parts.withColumn("shapley", shapley), "survivors")
    d = _walked(parts)
    after = F.col("before").bitwiseOR(F.col("bit"))
    everything = F.lit(SUBSETS - 1)
    others = everything.bitwiseAND(F.bitwise_not(F.col("bit")))
    failing = _at("n", F.lit(0)) - _at("n", F.col("bit"))
    removed = _at("n", F.col("before")) - _at("n", after)
    place = F.length(F.bin("bit")) - 1
    return d.select(
        "part", "filter_order", "step",
        _at("n", after).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (_at("n", others) - _at("n", everything)).alias("unique_fails"),
        (_at("g", F.col("before")) - _at("g", after)).alias("good_lost"),
        (_at("t", F.col("before")) - _at("t", after)).alias("toxic_lost"),
        F.get("shapley", place).alias("shapley"),
    )


AUDIT_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents),
judged AS (
  SELECT part, [len(w) < {MIN_WORDS}, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w),
      100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM base LEFT JOIN labels USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM judged GROUP BY 1, 2),
letters AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda x: substr('{FILTERS}', x, 1)), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders),
walked AS (
  SELECT part, filter_order, step, o[step] AS i, n, g, t, fails[o[step]] AS fail,
    coalesce(list_bool_or(list_transform(o[1:step-1], lambda x: fails[x])), false) AS gone,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM kinds, steps),
summed AS (
  SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (WHERE gone AND fail), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fail AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(g) FILTER (WHERE NOT gone AND fail), 0) AS good_lost, coalesce(sum(t) FILTER (WHERE NOT gone AND fail), 0) AS toxic_lost
  FROM walked GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM summed"""
