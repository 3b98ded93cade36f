"""Distinct n-grams of two corpora and the sides they are found on, in packed form.

A chunk of texts becomes arrays of digests, which are sorted, freed of repeats and cut into buckets;
a bucket's digests travel as one binary value.  Orders 3 and up share one record for each place in a
text: the digest of the three words there and shorter ones of the words after them.  So a place costs
24 bytes for the orders 3 to 5, and as a chunk sends each record once, a frequent n-gram is no hot key.

A task holds the buckets of one partition, of about ``TASK`` bytes whatever the size of the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.functions.text import word_tokens

CHUNK = 1 << 21  # tokens that are sorted together
TASK = 1 << 26  # bytes of records that one task merges
BUCKETS = 8  # per partition, so that partitions are of much the same size

_u64 = np.uint64
_low48 = _u64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


def _factors(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _u64(0x9E3779B97F4A7C15)) | _u64(1)


def _record(after: int) -> np.dtype:
    """96 bits of the first words, 48 of each word after them (0: the text has ended), the sides."""
    return np.dtype([("hi", "<u8"), ("lo", "<u4"), ("next", "<u2", (3 * after,))])


def _keys(records: np.ndarray) -> list[np.ndarray]:
    """The words after the first ones, as numbers."""
    parts = records["next"].astype(np.uint64)
    return [parts[:, i] << _u64(32) | parts[:, i + 1] << _u64(16) | parts[:, i + 2] for i in range(0, parts.shape[1], 3)]


def _order(records: np.ndarray) -> np.ndarray:
    """Places in the order of the digests, of the words after them where those are equal."""
    order = np.argsort(records["hi"], kind="stable")
    hi = records["hi"][order]
    same = np.zeros(len(hi) + 1, dtype=bool)
    same[1:-1] = hi[1:] == hi[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    if len(tied):
        few = records[order[tied]]
        order[tied] = order[tied][np.lexsort([*reversed(_keys(few)), few["lo"], few["hi"]])]
    return order


def _starts(records: np.ndarray) -> list[np.ndarray]:
    """Of sorted records, per level: where the first words, and then each word more, are new."""
    new = np.ones(len(records), dtype=bool)
    new[1:] = (records["hi"][1:] != records["hi"][:-1]) | (records["lo"][1:] != records["lo"][:-1])
    out = [new]
    for key in _keys(records):
        new = new.copy()
        new[1:] |= key[1:] != key[:-1]
        out.append(new)
    return out


def _hashed(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 64 bits for each token."""
    coded = tokens.dictionary_encode()
    words = [xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    both = np.frombuffer(b"".join(words), dtype=np.uint64).reshape(-1, 2)
    at = coded.indices.to_numpy()
    return both[at, 0], both[at, 1]


def _records(a: np.ndarray, b: np.ndarray, ends: np.ndarray, first: int, last: int) -> np.ndarray:
    """The distinct records of tokens, sorted; ``ends``: where the text of each token ends."""
    at = np.flatnonzero(np.arange(len(a)) + first <= ends)
    out = np.empty(len(at), dtype=_record(last - first))
    hi, lo = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
    for k, f in enumerate(_factors(first)):
        hi += a[at + k] * f
        lo += b[at + k] * f
    out["hi"], out["lo"] = _mix(hi), _mix(lo) >> _u64(32)
    for j in range(last - first):
        inside = at + first + j < ends[at]
        word = np.zeros(len(at), dtype=np.uint64)
        word[inside] = np.maximum(a[at[inside] + first + j] & _low48, _u64(1))
        for i, shift in enumerate((32, 16, 0)):
            out["next"][:, 3 * j + i] = (word >> _u64(shift)) & _u64(0xFFFF)
    out = out[_order(out)]
    return out[_starts(out)[-1]]


def _packed(df: DataFrame, text: str, side: int, families: list[tuple[int, int]], bits: int) -> DataFrame:
    """``family, side, bucket, records`` of the n-grams of each family (from one order to another)."""

    def cut(tokens: pa.Array, ends: np.ndarray):
        a, b = _hashed(tokens)
        for i, (first, last) in enumerate(families):
            records = _records(a, b, ends, first, last)
            bucket = (records["hi"] >> _u64(64 - bits)).astype(np.int64)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            raw, width = records.tobytes(), records.dtype.itemsize
            stops = [*at[1:].tolist(), len(records)]
            blobs = [raw[s * width : e * width] for s, e in zip(at.tolist(), stops, strict=False)]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(bucket[at], pa.int64()), pa.array(blobs, pa.binary())],
                names=["family", "side", "bucket", "records"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, total = [], [], 0
        for batch in batches:
            col = batch.column(0)
            offsets = col.offsets.to_numpy()
            at = 0
            while at < len(col):  # as many texts as fit; one that does not fit goes alone
                to = int(np.searchsorted(offsets, offsets[at] + CHUNK - total, side="right")) - 1
                to = min(max(to, at + (not held)), len(col))
                if to > at:
                    held.append(col.values.slice(offsets[at], offsets[to] - offsets[at]))
                    sizes.append(np.diff(offsets[at : to + 1]))
                    total += int(offsets[to] - offsets[at])
                if to < len(col):
                    yield from cut(*_joined(held, sizes))
                    held, sizes, total = [], [], 0
                at = to
        if total:
            yield from cut(*_joined(held, sizes))

    tokens = df.where(F.col(text).isNotNull()).select(word_tokens(F.col(text)).alias("tokens"))
    return tokens.mapInArrow(run, "family int, side int, bucket bigint, records binary")


def _joined(held: list[pa.Array], sizes: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    size = np.concatenate(sizes).astype(np.int64)
    return pa.concat_arrays(held), np.repeat(np.cumsum(size), size)


def merged(
    a: DataFrame,
    b: DataFrame,
    text: str,
    families: list[tuple[int, int]],
    told: Callable[[tuple[int, int], np.ndarray, np.ndarray], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """What ``told`` makes of each family's distinct records, sorted, and their sides (1: a, 2: b, 3: both).

    A bucket is in one partition, so what is told of partitions adds up.
    """
    spark = a.sparkSession
    size = sum(d.agg(F.sum(F.octet_length(text))).first()[0] or 0 for d in (a, b))
    places = size / 5 * sum(_record(last - first).itemsize for first, last in families)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(places / TASK))
    bits = math.ceil(math.log2(BUCKETS * partitions))
    rows = _packed(a, text, 1, families, bits).unionByName(_packed(b, text, 2, families, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict = {}
        for batch in batches:
            for family, side, _, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blobs.setdefault((family, side), []).append(records)
        for i, (first, last) in enumerate(families):
            raw = [b"".join(blobs.pop((i, side), [])) for side in (1, 2)]
            records = np.concatenate([np.frombuffer(r, dtype=_record(last - first)) for r in raw])
            sides = np.repeat(np.array([1, 2], dtype=np.uint8), [len(r) // records.dtype.itemsize for r in raw])
            del raw
            if not len(records):
                continue
            order = _order(records)
            yield told((first, last), records[order], sides[order])

    return rows.repartition(partitions, "bucket").mapInArrow(run, schema)


def _counts(family: tuple[int, int], records: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    """Per order: how many n-grams are on the first side, the second, both, and in all."""
    out = []
    keys = [None, *_keys(records)]
    for j, new in enumerate(_starts(records)):
        whole = np.ones(len(records), dtype=bool) if j == 0 else keys[j] != 0  # the text has words enough
        at = np.flatnonzero(new)
        flags = np.bitwise_or.reduceat(sides, at)[whole[at]]
        out.append((family[0] + j, int((flags & 1 > 0).sum()), int((flags & 2 > 0).sum()), int((flags == 3).sum()), len(flags)))
    kinds = [pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["n", "a", "b", "both", "either"])


def counted(a: DataFrame, b: DataFrame, text: str, max_n: int) -> DataFrame:
    """``n, a, b, both, either``: distinct n-grams per order up to ``max_n`` that have any."""
    families = [(n, n) for n in range(1, min(max_n, 2) + 1)] + ([(3, max_n)] if max_n > 2 else [])
    d = merged(a, b, text, families, _counts, "n int, a bigint, b bigint, both bigint, either bigint")
    return d.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("a", "b", "both", "either")])


def _sides(_: tuple[int, int], records: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(_starts(records)[-1])
    cols = [records["hi"][at].view(np.int64), records["lo"][at].astype(np.int64), np.bitwise_or.reduceat(sides, at).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g1", "g2", "sides"])


def sets(a: DataFrame, b: DataFrame, text: str, n: int) -> DataFrame:
    """``g1, g2, sides``: the digest of every n-gram of either corpus with the sides it is found on."""
    return merged(a, b, text, [(n, n)], _sides, "g1 bigint, g2 bigint, sides int")
