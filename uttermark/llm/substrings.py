"""Exact removal of long repeated byte strings, by sorting suffixes from anchored places.

Every string of LENGTH bytes has an anchor: the place in it where KMER bytes have the least hash.
Equal strings have the anchor at the same place, so only strings whose anchors look alike need to
be compared, and a document has one anchor per some seventy bytes.

1. Anchors with the stretch of text around them (hashed) meet by the anchor's hash.  A stretch that
   occurs twice is covered as a whole; an anchor that occurs once is dropped.
2. Where one anchor has different stretches, their suffixes are sorted (see ``deepshallow``), once
   per different stretch.  Runs of equal LENGTH-byte strings that occur twice are covered.
   Anchors with very many stretches are sorted in chunks, and runs of one are merged by digest.
3. Covered places are put together per text, and the rest of the text remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm.common import stored
from uttermark.llm.deepshallow import sort_strings
from uttermark.llm.minhash import mix

LENGTH = 200
KMER = 48
WINDOW = LENGTH - KMER + 1  # places of the anchor within a string
STRETCHES = 4096  # different stretches of one anchor that are sorted together
BLOCK = 1 << 17  # bytes of small documents that are hashed together
PIECE = 1 << 23  # bytes of a long document that are hashed at a time
SORTED = 400_000  # strings sorted together

_u = np.uint64
_letter = mix(np.arange(1, 257, dtype=np.uint64) * _u(0x9E3779B97F4A7C15))
_place_bits = _u(24)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KMER = 32 + 16 bytes from every place, by doubling."""
    h = _letter[data]
    size = 1
    while size < 32:
        if size == 16:
            h16 = h
        h = h[:-size] * _u(0xD6E8FEB86659FD93) ^ h[size:]
        h = (h ^ (h >> _u(32))) * _u(0x9FB21C651E98DF25)
        size *= 2
    n = len(data) - KMER + 1
    return mix(h[:n] * _u(0xA0761D6478BD642F) + h16[32 : 32 + n])


def anchor_runs(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of strings with one anchor: hash, first string, last string, anchor.

    ``data`` is one text of LENGTH bytes or more.  Ties go to the first place, by content alone.
    """
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        piece = data[at : at + PIECE + LENGTH - 1]
        h = kmer_hashes(piece)
        yield tuple(x if i == 0 else x + at for i, x in enumerate(_runs(h)))


def _runs(h: np.ndarray):
    low = (h >> _place_bits << _place_bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(h) - WINDOW + 1], low[WINDOW - size :])
    anchor = (low & ((_u(1) << _place_bits) - _u(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    return h[anchor[first]], first, last, anchor[first]


def text_runs(texts: list[bytes]):
    """Runs of many texts: number of the text, hash, first, last, anchor (places in the text)."""
    out, block, size = [], [], 0
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > BLOCK // 4:
            for h, first, last, anchor in anchor_runs(np.frombuffer(t, dtype=np.uint8)):
                out.append((np.full(len(h), i), h, first, last, anchor))
            continue
        block.append(i)
        size += len(t)
        if size >= BLOCK:
            out.append(_block_runs(texts, block))
            block, size = [], 0
    if block:
        out.append(_block_runs(texts, block))
    if not out:
        return tuple(np.zeros(0, dtype=np.uint64 if k == 1 else np.int64) for k in range(5))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def _block_runs(texts: list[bytes], ids: list[int]):
    data = np.frombuffer(b"".join([texts[i] for i in ids]), dtype=np.uint8)
    sizes = np.array([len(texts[i]) for i in ids])
    begin = np.cumsum(sizes) - sizes
    h, first, last, anchor = next(anchor_runs(data))
    # Cut the runs at the texts' ends, and drop strings that reach over them.
    owner = np.searchsorted(begin, first, side="right") - 1
    to = np.searchsorted(begin, last, side="right") - 1
    if (owner != to).any():
        # An anchor is inside every string of its run, so a run over a border belongs to one side:
        # the strings that do not reach over it are in the text where the run begins or ends.
        tail = owner != to
        again = (h[tail], begin[to[tail]], last[tail], anchor[tail], to[tail])
        last = np.where(tail, begin[owner] + sizes[owner] - LENGTH, last)
        h, first, last, anchor, owner = (
            np.concatenate(p) for p in zip((h, first, last, anchor, owner), again, strict=True)
        )
    last = np.minimum(last, begin[owner] + sizes[owner] - LENGTH)
    good = last >= first
    h, first, last, anchor, owner = h[good], first[good], last[good], anchor[good], owner[good]
    base = begin[owner]
    return np.array(ids)[owner], h, first - base, last - base, anchor - base


# A place is packed: first string (40 bits), number of strings less one (12), and the anchor's
# distance from the first string (12).  Runs are at most WINDOW strings long but for ties.


def _packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return (first << 24) | ((last - first) << 12) | (anchor - first)


def unpacked(p: np.ndarray):
    first = p >> 24
    return first, first + ((p >> 12) & 4095), first + (p & 4095)


_MET = "kind int, h bigint, chunk int, n int, rid bigint, sub int, place bigint"


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """``rid, sub, text``: texts named by 96 bits of hashes, null texts as empty ones."""
    rid, sub, t = text_ids(F.col(text))
    return docs.select(rid.alias("rid"), sub.alias("sub"), t.alias("text"))


def anchored(docs: DataFrame) -> DataFrame:
    """Anchors of all texts: h, ck (hash of the stretch), n, rid, sub, place.

    What occurs twice within a batch is covered at once (h null) and sent on as one row (n = 2), so
    that frequent passages hardly travel.
    """
    schema = "h bigint, ck bigint, n int, rid bigint, sub int, place bigint"

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                texts = [t.encode() for t in part.column(2).to_pylist()]
                i, h, first, last, anchor = text_runs(texts)
                if not len(i):
                    continue
                place = _packed(first, last, anchor)
                digest = xxhash.xxh3_64_intdigest
                ck = np.fromiter(
                    (
                        digest(texts[a][b:c], seed=d)
                        for a, b, c, d in zip(i.tolist(), first.tolist(), (last + LENGTH).tolist(), (anchor - first).tolist(), strict=True)
                    ),
                    dtype=np.uint64,
                    count=len(i),
                )
                rid = np.asarray(part.column(0))[i]
                sub = np.asarray(part.column(1))[i]
                order = np.lexsort((ck, h))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(h[order]) != 0) | (np.diff(ck[order]) != 0)
                run_no = np.cumsum(new) - 1
                times = np.bincount(run_no)
                twice = np.zeros(len(order), dtype=bool)
                twice[order] = times[run_no] > 1
                one = np.zeros(len(order), dtype=bool)
                one[order] = new
                lone, many = ~twice, twice & one
                yield _rows(None, None, 0, rid[twice], sub[twice], place[twice])
                yield _rows(h[lone], ck[lone], 1, rid[lone], sub[lone], place[lone])
                yield _rows(h[many], ck[many], 2, rid[many], sub[many], place[many])

    def _rows(h, ck, n, rid, sub, place):
        null = pa.nulls(len(place), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                null if h is None else pa.array(h.view(np.int64)),
                null if ck is None else pa.array(ck.view(np.int64)),
                pa.array(np.full(len(place), n, dtype=np.int32)),
                pa.array(rid),
                pa.array(sub),
                pa.array(place),
            ],
            names=["h", "ck", "n", "rid", "sub", "place"],
        )

    return identified(docs).mapInArrow(run, schema)


def met(anchors: DataFrame, together: int = STRETCHES) -> DataFrame:
    """Rows sorted by anchor become covers (kind 0) and stretches to be sorted (kind 1).

    One pass over sorted rows that holds one row at a time: the first of each stretch waits until
    a second stretch of the same anchor, or the same stretch again, shows that it is needed.
    """

    def run(batches):
        held = None  # h, ck, n, rid, sub, place of the stretch at hand
        seen = 0  # stretches of this anchor so far
        waiting = None  # the first stretch, until a second one comes
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                h, ck, n, rid, sub, place = row
                if h is None:
                    out.append((0, None, 0, n, rid, sub, place))
                    continue
                if held and held[0] == h and held[1] == ck:
                    for r in (held, row):  # what counts for one has not been covered yet
                        if r[2] == 1:
                            out.append((0, None, 0, 0, *r[3:]))
                    held = (h, ck, 2, *held[3:])
                    continue
                waiting, seen = _close(held, waiting, seen, h, out)
                held = row
            yield _met_batch(out)
        out = []
        _close(held, waiting, seen, None, out)
        yield _met_batch(out)

    def _close(held, waiting, seen, h, out):
        """The stretch at hand is over; ``h`` is the anchor that comes next."""
        if held is None:
            return None, 0
        chunk = seen // together
        row = (1, held[0], chunk, held[2], *held[3:])
        if seen == 0:
            waiting = row
        else:
            if seen == 1:
                out.append(waiting)
            out.append(row)
        return (waiting, seen + 1) if held[0] == h else (None, 0)

    def _met_batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = [f.split(" ")[0] for f in _MET.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    # Rows without an anchor need no company: they are dealt out by their text.
    by = F.coalesce("h", F.xxhash64("rid", "place"))
    ordered = anchors.withColumn("by", by).repartition("by").sortWithinPartitions("h", "ck", "n")
    return ordered.select("h", "ck", "n", "rid", "sub", "place").mapInArrow(run, _MET)


def squeezed(docs: DataFrame, *keep: str) -> DataFrame:
    """``rid, sub``, the text compressed as ``z``, and further columns, for a cheaper shuffle."""
    rid, sub, text = text_ids(F.col("text"))
    named = docs.select(*keep, rid.alias("rid"), sub.alias("sub"), text.alias("text"))
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("z", T.BinaryType())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(t.encode()) for t in batch.column(-1).to_pylist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], z], names=schema.names)

    return named.mapInArrow(run, schema)


def text_ids(text):
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.crc32(t.cast("binary")).bitwiseAND(0x7FFFFFFF).cast("int"), t]


def stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h, chunk, n, rid, sub, place, data``: the bytes of the wanted stretches."""
    lists = wanted.groupBy("rid", "sub").agg(
        F.collect_list(F.struct("h", "chunk", "n", "place")).alias("w")  # at most the text's length
    )
    rows = squeezed(docs).dropDuplicates(["rid", "sub"]).join(lists, ["rid", "sub"])
    schema = "h bigint, chunk int, n int, rid bigint, sub int, place bigint, data binary"

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(len(batch)):
                rid, sub, z, w = (c[at].as_py() for c in batch.columns)
                text = unpack.decompress(z)
                place = [x["place"] for x in w]
                first, last, _ = unpacked(np.array(place))
                data = [text[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["h"] for x in w], type=pa.int64()),
                        pa.array([x["chunk"] for x in w], type=pa.int32()),
                        pa.array([x["n"] for x in w], type=pa.int32()),
                        pa.array([rid] * len(w), type=pa.int64()),
                        pa.array([sub] * len(w), type=pa.int32()),
                        pa.array(place, type=pa.int64()),
                        pa.array(data, type=pa.binary()),
                    ],
                    names=["h", "chunk", "n", "rid", "sub", "place", "data"],
                )

    return rows.select("rid", "sub", "z", "w").mapInArrow(run, schema)


def sorted_runs(rows: DataFrame, together: int = STRETCHES) -> DataFrame:
    """Sort the strings of each anchor's stretches: covers (kind 0), and, for anchors in several
    chunks, runs of one (kind 2) with their digest, and digests of longer runs (kind 3)."""
    schema = "kind int, digest binary, rid bigint, sub int, place bigint"

    def run(batches):
        groups: list[tuple[bool, list]] = []
        size, key, group = 0, None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (row[0], row[1]) != key:
                    if group:
                        groups.append((key[1] > 0 or len(group) >= together, group))
                    if size > SORTED:
                        yield _sorted(groups)
                        groups, size = [], 0
                    key, group = (row[0], row[1]), []
                group.append(row[2:])
                size += 1 + ((row[5] >> 12) & 4095)
        if group:
            groups.append((key[1] > 0 or len(group) >= together, group))
        yield _sorted(groups)

    def _sorted(groups):
        n, place, data, rid, sub, number, open_ = [], [], [], [], [], [], []
        for g, (many, members) in enumerate(groups):
            # Row copies of one stretch are one.
            for m in {(r, s, p): (k, d) for k, r, s, p, d in members}.items():
                (r, s, p), (k, d) = m
                n.append(k)
                rid.append(r)
                sub.append(s)
                place.append(p)
                data.append(d)
                number.append(g)
                open_.append(many)
        if not n:
            return _run_batch([])
        joined = np.frombuffer(b"".join(data), dtype=np.uint8)
        sizes = np.array([len(d) for d in data])
        base = np.cumsum(sizes) - sizes
        first, last, anchor = unpacked(np.array(place))
        count = last - first + 1
        owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        group = np.array(number)[owner] * 4096 + (anchor - first)[owner] - k
        order, run_no = sort_strings(joined, base[owner] + k, group + 4096, LENGTH)
        times = np.bincount(run_no, weights=np.array(n)[owner[order]])
        found = np.empty(len(order), dtype=bool)
        found[order] = times[run_no] > 1
        out = []
        # Neighbouring strings of one stretch as one cover; stretches seen twice are covered already.
        cover = found & (np.array(n)[owner] == 1)
        edge = np.diff(np.where(cover, owner, -1), prepend=-1, append=-1) != 0
        begin = np.flatnonzero(edge[:-1] & cover)
        end = np.flatnonzero(edge[1:] & cover)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            o = owner[b]
            a = int(first[o])
            out.append((0, None, rid[o], sub[o], int(_packed(a + k[b], a + k[e], a + k[b]))))
        many = np.array(open_)[owner]
        if many.any():
            lead = np.zeros(len(order), dtype=bool)
            lead[order] = np.diff(run_no, prepend=-1) != 0
            text = joined.tobytes()
            for j in np.flatnonzero(many & lead).tolist():
                o = owner[j]
                at = int(base[o] + k[j])
                digest = xxhash.xxh3_128_digest(text[at : at + LENGTH])
                start = int(first[o] + k[j])
                one = not found[j]
                out.append((2, digest, rid[o], sub[o], start << 24) if one else (3, digest, None, None, None))
        return _run_batch(out)

    def _run_batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)],
            names=["kind", "digest", "rid", "sub", "place"],
        )

    ordered = rows.repartition("h", "chunk").sortWithinPartitions("h", "chunk")
    return ordered.select("h", "chunk", "n", "rid", "sub", "place", "data").mapInArrow(run, schema)


def covers(docs: DataFrame, together: int = STRETCHES) -> DataFrame:
    """``rid, sub, places``: per text the places (packed) whose strings occur elsewhere."""
    rows = stored(met(anchored(docs), together), "met")
    runs = stored(sorted_runs(stretches(docs, rows.where("kind = 1")), together), "runs")
    across = runs.where("kind >= 2")
    twice = across.groupBy("digest").agg(F.sum("kind").alias("k")).where("k > 2").select("digest")
    late = runs.where("kind = 2").join(twice, "digest")  # 2: once; 3: oftener than once
    every = reduce_union([x.select("rid", "sub", "place") for x in (rows.where("kind = 0"), runs.where("kind = 0"), late)])
    return every.distinct().groupBy("rid", "sub").agg(F.collect_list("place").alias("places"))


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def removed(docs: DataFrame, together: int = STRETCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` of every document; ``kept`` as bytes.

    Null texts count as empty; texts shorter than LENGTH stay whole; repeated rows and copies are
    occurrences of each other and lose all that is in a long enough string; an empty table gives
    no rows.  Only ``doc_id`` and ``text`` are looked at.
    """
    d = docs.select("doc_id", "text")
    rows = squeezed(d, "doc_id").join(stored(covers(d, together), "covers"), ["rid", "sub"], "left")
    schema = T.StructType(
        [
            d.schema["doc_id"],
            *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
            T.StructField("kept", T.BinaryType()),
        ]
    )

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, z, places = batch.columns
            out = [cut(unpack.decompress(t), p) for t, p in zip(z.to_pylist(), places.to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [pa.array(c, type=pa.int64()) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([ids, *arrays, pa.array(cols[3], type=pa.binary())], names=schema.names)

    return rows.select("doc_id", "z", "places").mapInArrow(run, schema)


def cut(text: bytes, places: list[int] | None) -> tuple[int, int, int, bytes]:
    """Bytes of a text, bytes removed, runs removed, and what is left."""
    if not places:
        return len(text), 0, 0, text
    first, last, _ = unpacked(np.array(places))
    step = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + LENGTH, -1)
    gone = np.cumsum(step)[:-1] > 0
    spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), spans, left
