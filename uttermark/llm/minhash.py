"""Near-duplicate documents by SuperMinHash.

A document is the set of its five-word shingles.  In SuperMinHash every shingle has a random
permutation of the signature's places; it offers its j-th rank to the place that its permutation
names j-th.  Ranks rise, so once every place has an offer of an earlier rank, later ranks cannot
matter and the work stops: about one rank for long documents.  (The permutations are drawn from
the affine ones of a prime number of places, which need no memory.)

Signatures are cut into bands.  Documents that agree in a band are compared on their full sets.
Copies of one set are one node.  In each bucket the nodes are first compared with the one that
shares most buckets, and components are formed; so large groups of copies never make all their
pairs.  Nodes whose buckets still hold several components, such as documents that merely share a
frequent line, get longer signatures with wider bands, which tell 75 % from a half far better.
There neighbours in a bucket are compared, and components are joined; and then all nodes of different
components that share a bucket: blocks of the bucket meet in tasks of their own.  No pair leaves them:
nodes whose signatures agree well enough are one group, each a row of it, and a group that several
buckets make is one.  The full sets of a group meet in one task, which gives the links of a forest.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from uttermark.llm.common import discard, fresh, sifted, stored
from uttermark.llm.components import merged

SHINGLE = 5
PERCENT = 75
#: (places, places per band): a prime, of which the last places are left over.  A pair at 75 %
#: meets in no band with a probability of 5e-6 and 9e-6.
COARSE = (131, 4)
FINE = (881, 8)
#: What pairs are compared by before their full sets are: four bits of so many places of a fine
#: signature; and how many places may differ, four standard deviations more than do at 75 %.  The
#: fewer shingles both have together, the less that varies: half the variance in short texts.
NIBBLES = 880
MAY_DIFFER = ((1050, 244), (1750, 245), (3500, 248), (7000, 252))  # up to so many shingles
MAY_DIFFER_ELSE = 257
BLOCK = 512  # nodes of a bucket that meet the same others
BLOCK_SHINGLES = 1 << 20  # and about how many shingles they may have together
CHUNK = 1 << 17  # shingles that offer together
FEW = 10_000  # ids that are broadcast as they are
REMEMBERED = 100_000  # words, some 15 MB in each Python process

_word = re.compile(rb"[^\x20\x09-\x0D]+")
_u64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()
_golden = np.arange(1, 4097, dtype=np.uint64) * _u64(0x9E3779B97F4A7C15)
_factors = mix(_golden[:SHINGLE]) | _u64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    words = _word.findall((text or "").encode().lower())  # of bytes: A-Z only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=n)
    total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * _factors[k]
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """One row per set (none may be empty): the least (rank, draw) offered to each place.

    A value has the rank in its top twelve bits and the draw below them.
    """
    out = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        group = sets[start:end]
        owner = np.repeat(np.arange(len(group)), [len(s) for s in group])
        items = np.concatenate(group)
        for at in range(0, len(items), CHUNK):  # a very long document takes several turns
            _offer(out[start:end], owner[at : at + CHUNK], items[at : at + CHUNK])
        start = end
    return out


def _offer(out: np.ndarray, owner: np.ndarray, items: np.ndarray) -> None:
    places = out.shape[1]
    flat = out.reshape(-1)
    step = (1 + mix(items ^ _u64(0x5851F42D4C957F2D)) % _u64(places - 1)).astype(np.int64)
    place = (mix(items ^ _u64(0x14057B7EF767814F)) % _u64(places)).astype(np.int64)
    look = 0
    for rank in range(places):
        draw = mix(items + _golden[rank])
        np.minimum.at(flat, owner * places + place, (_u64(rank) << _u64(52)) | (draw >> _u64(12)))
        place += step
        place[place >= places] -= places
        if rank < look:
            continue
        look = rank + 1 + rank // 4
        ids = np.unique(owner)
        missing = ids[out[ids].max(axis=1) >= (_u64(rank + 1) << _u64(52))]
        if not len(missing):
            return
        if len(missing) < len(ids):
            keep = np.isin(owner, missing)
            owner, items, step, place = owner[keep], items[keep], step[keep], place[keep]


def band_hashes(signature: np.ndarray, width: int) -> np.ndarray:
    """One hash per band of so many places, different bands never meeting."""
    count = signature.shape[1] // width
    bands = signature[:, : count * width].reshape(len(signature), count, width)
    h = np.broadcast_to(_golden[:count], bands.shape[:2])
    for k in range(width):
        h = mix(h ^ bands[:, :, k])
    return h


def _batches(col: pa.Array, step: int = 2000) -> Iterator[list]:
    for at in range(0, len(col), step):
        yield col.slice(at, step).to_pylist()


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, bands``; node is a fingerprint of the set, null if it is empty."""
    places, width = COARSE
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(1)):
                sets = [shingle_set(t) for t in texts]
                full = [s for s in sets if len(s)]
                made = signatures(full, places) if full else np.zeros((0, places), dtype=np.uint64)
                bands = iter(band_hashes(made, width).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], type=pa.int64()),
                        pa.array([fingerprint(s) for s in sets], type=pa.binary()),
                        pa.array([next(bands) if len(s) else [] for s in sets], type=pa.list_(pa.int64())),
                    ],
                    names=schema.names,
                )
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, items`` of the wanted nodes, made anew from the texts of their first documents."""
    texts, _ = sifted(docs.select("doc_id", "text"), wanted.select("doc_id"))
    hits = texts.join(wanted.select("doc_id", "node"), "doc_id")
    hits = hits.dropDuplicates(["doc_id", "node", "text"])  # where the join has dealt them out by id
    schema = "node binary, items array<bigint>"

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                nodes, items = [], []
                rows = batch.slice(at, 2000)
                for text, node in zip(rows.column("text").to_pylist(), rows.column("node").to_pylist(), strict=True):
                    s = shingle_set(text)
                    if fingerprint(s) == node:  # another row may share the id
                        nodes.append(node)
                        items.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, type=pa.binary()), pa.array(items, type=pa.list_(pa.int64()))],
                    names=["node", "items"],
                )

    return hits.mapInArrow(run, schema)


def fine_signatures(sets: DataFrame) -> DataFrame:
    """``node, n_shingles, bands, nibbles`` of stored sets ``node, items``, of the fine size."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                ends = rows.column(1).offsets.to_numpy()
                items = rows.column(1).values.to_numpy().view(np.uint64)
                sets = [items[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                made = signatures(sets, FINE[0])
                few = made[:, :NIBBLES] & _u64(15)
                short = (few[:, ::2] << _u64(4) | few[:, 1::2]).astype(np.uint8).view(np.int64)
                cols = [rows.column(0), pa.array([len(x) for x in sets], type=pa.int64())]
                cols += [pa.array(list(x), type=pa.list_(pa.int64())) for x in (band_hashes(made, FINE[1]).view(np.int64), short)]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "n_shingles", "bands", "nibbles"])

    return sets.mapInArrow(run, "node binary, n_shingles bigint, bands array<bigint>, nibbles array<bigint>")


def fitting(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``u, v, n_u, n_v`` of the pairs whose sizes allow 75 %, stored."""
    size = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    pairs = pairs.join(size("u"), "u").join(size("v"), "v")
    fits = 100 * F.least("n_u", "n_v") >= PERCENT * F.greatest("n_u", "n_v")
    return stored(pairs.where(fits).select("u", "v", "n_u", "n_v"), "pairs")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``fitting`` whose full sets are similar enough, stored."""
    # The pivot, v, may be in many pairs: its set joins last, where skewed partitions are split.
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.select("u", "v", "n_u", "n_v", shared.alias("k"))
    alike = 100 * F.col("k") >= PERCENT * (F.col("n_u") + F.col("n_v") - F.col("k"))
    out = stored(both.where(alike).select("u", "v"), "confirmed")
    discard(pairs)
    return out


def node_components(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (distinct sets) with their first document, and ``node, root`` of the linked ones."""
    nodes = stored(
        rows.where("node IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")),
        "nodes",
    )
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    crowded = places.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    sizes = stored(places.join(crowded, "bucket"), "sizes")
    shared = sizes.groupBy("node").agg(F.sum("size").alias("shared"))
    members = stored(sizes.drop("size").join(shared, "node"), "members")
    discard(sizes)
    nodes = nodes.drop("bands")

    # Everyone with the member of the bucket that meets most others.
    top = members.groupBy("bucket").agg(F.max_by("node", F.struct("shared", "node")).alias("v"))
    pairs = members.join(top, "bucket").where("node != v").select(F.col("node").alias("u"), "v").distinct()
    pairs = fitting(nodes, pairs)
    alone = members.select("node").distinct().withColumn("root", F.col("node"))
    labels = stored(alone, "labels")
    # The texts are read once, for all nodes that share a bucket; what follows takes the sets.
    wanted = stored(nodes.join(labels, "node").select("doc_id", "node"), "wanted")
    met = stored(full_sets(docs, wanted), "sets")
    discard(wanted)
    labels = merged(labels, confirmed(pairs, met))

    # Buckets that hold several components: their nodes meet again in finer bands.
    mixed = members.join(labels, "node").groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    open_ = members.join(mixed.where("a != b").select("bucket"), "bucket").select("node").distinct()
    open_ = stored(open_, "open")
    sets = sifted(met, open_)[0].join(open_, "node", "left_semi")
    sets = stored(sets.dropDuplicates(["node"]), "open-sets")  # different texts under one id may have one set
    discard(open_)
    discard(met)
    discard(members)
    again = stored(fine_signatures(sets), "fine-signatures")
    places = again.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    crowded = places.groupBy("bucket").agg(F.count("*").alias("size"), _pieces().alias("pieces")).where("size > 1")
    fine = stored(places.join(crowded, "bucket"), "fine")
    short = again.select("node", "nibbles")

    # Neighbours in a bucket first, over some bands, then over all: what is linked by now mostly
    # falls into one component before all others are compared.  Large buckets are dealt out in
    # pieces, other ones in each band, so that they meet across pieces as well.
    for bands in (F.col("band") % 7 == 0, F.lit(True)):
        rows = fine.where(bands).join(labels, "node")
        beside = W.Window.partitionBy("bucket", _piece()).orderBy(F.xxhash64("node"), "node")
        last = rows.withColumns({f"v_{c}": F.lag(c).over(beside) for c in ("node", "root", "n_shingles")})
        pairs = last.where((F.col("root") != F.col("v_root")) & _sizes_fit())
        pairs = pairs.select("node", "v_node", "n_shingles", "v_n_shingles").distinct()
        pairs = pairs.join(short, "node").join(short.select(*[F.col(c).alias(f"v_{c}") for c in short.columns]), "v_node")
        pairs = pairs.where(_nibbles_agree()).select(F.col("node").alias("u"), F.col("v_node").alias("v"))
        labels = _with_links(labels, again, pairs, sets)

    rows = fine.join(labels, "node")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    rows = rows.join(mixed.select("bucket"), "bucket").join(short, "node")
    near = stored(alike(rows).distinct(), "alike")
    if not near.isEmpty():
        known = again.select("node", "n_shingles", "nibbles").join(labels, "node").join(sets, "node")
        labels = merged(labels, forests(near.join(known, "node")))
    discard(near)
    for used in (sets, again, fine):
        discard(used)
    return nodes, labels


def _with_links(labels: DataFrame, nodes: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    pairs = fitting(nodes, pairs)
    return labels if pairs.isEmpty() else merged(labels, confirmed(pairs, sets))


def _pieces():
    """Into how many blocks a bucket is cut."""
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES))


def _piece():
    return F.pmod(F.xxhash64("node", "bucket"), F.col("pieces"))


def alike(rows: DataFrame) -> DataFrame:
    """``part, side, node``: the nodes of ``bucket, pieces, node, root, n_shingles, nibbles`` that share
    a bucket with one of another root, where sizes and signatures allow 75 %.

    A bucket is cut into blocks, and every two of them meet; so a row is sent once for each block of
    its bucket.  What leaves is at most a row for each that came: nodes connected by such pairs have
    one ``part``, named by its nodes.  Of two blocks, only nodes of different ``side`` have met.
    """
    d = rows.withColumn("own", _piece()).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    d = d.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "root", "n_shingles", "nibbles")
    return _by_group(d, ["bucket", "a", "b"], _block_parts, "part binary, side int, node binary")


def forests(rows: DataFrame) -> DataFrame:
    """Links (u, v) of ``part, side, node, root, n_shingles, nibbles, items``, confirmed on the full sets.

    Nodes already in one tree are not compared again, so a part of n nodes gives n - 1 links at most.
    """
    d = rows.select("part", "side", "node", "root", "n_shingles", "nibbles", "items")
    return _by_group(d, ["part"], _part_links, "u binary, v binary")


def _by_group(rows: DataFrame, keys: list[str], made, schema: str) -> DataFrame:
    """``made`` of the table of each group of rows with equal keys."""
    names = [f.split()[0] for f in schema.split(", ")]
    types = T.StructType.fromDDL(schema)
    kinds = [pa.int32() if f.dataType == T.IntegerType() else pa.binary() for f in types]

    def batch_of(found):
        cols = [pa.array([row[i] for row in found], type=kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        waiting: list = []  # batches of the group that the last one ended with
        last = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            key = list(zip(*columns, strict=True))
            at = 0
            while at < len(key):
                end = bisect.bisect_right(key, key[at], lo=at) if key[-1] != key[at] else len(key)
                if waiting and key[at] != last:
                    yield batch_of(made(pa.Table.from_batches(waiting)))
                    waiting = []
                waiting.append(batch.slice(at, end - at))
                last, at = key[at], end
        if waiting:
            yield batch_of(made(pa.Table.from_batches(waiting)))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


_totals = np.array([total for total, _ in MAY_DIFFER])
_limits = np.array([most for _, most in MAY_DIFFER] + [MAY_DIFFER_ELSE])
_unequal = np.array([(x > 15) + (x & 15 > 0) for x in range(256)], dtype=np.uint8)  # nibbles of a byte that are set


class _Meeting:
    """The nodes of a table, with the trees they are in: those of one root at first."""

    def __init__(self, t: pa.Table, side: np.ndarray):
        self.nodes = t.column("node").to_pylist()
        self.side, self.n = side, t.column("n_shingles").to_numpy()
        self.tree = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
        self.index = np.arange(len(self.nodes))
        if self.tree.max():
            nibbles = t.column("nibbles").combine_chunks().flatten().to_numpy()
            self.short = nibbles.reshape(len(self.nodes), -1).view(np.uint8)

    def near(self, i: int) -> np.ndarray:
        """Later nodes in another tree that the signatures allow to be like node i."""
        n, side = self.n, self.side
        fits = (self.index > i) & (self.tree != self.tree[i]) & ((side == 0) | (side != side[i]))
        fits &= 100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])
        near = np.flatnonzero(fits)
        if not len(near):
            return near
        most = _limits[np.searchsorted(_totals, n[near] + n[i])]
        return near[_unequal[self.short[near] ^ self.short[i]].sum(axis=1, dtype=np.int64) <= most]


def _block_parts(t: pa.Table) -> list[tuple[bytes, int, bytes]]:
    """The rows of one task of ``alike``: of one block (side 0), or across two (sides 1 and 2)."""
    own, a, b = (t.column(c).to_numpy() for c in ("own", "a", "b"))
    m = _Meeting(t, np.zeros(len(own), dtype=np.int64) if a[0] == b[0] else 1 + (own == b))
    if not m.tree.max():
        return []
    group = m.index.copy()
    for i in m.index.tolist():
        for j in m.near(i).tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
    out = []
    for g in np.flatnonzero(np.bincount(group) > 1).tolist():
        rows = sorted((int(m.side[k]), m.nodes[k]) for k in np.flatnonzero(group == g).tolist())
        part = xxhash.xxh3_128_digest(b"".join(bytes([side]) + node for side, node in rows))
        out += [(part, side, node) for side, node in rows]
    return out


def _part_links(t: pa.Table) -> list[tuple[bytes, bytes]]:
    """The links of one task of ``forests``."""
    m = _Meeting(t, t.column("side").to_numpy())
    items = t.column("items").combine_chunks()
    ends, values = items.offsets.to_numpy(), items.values.to_numpy()
    sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = []
    for i in m.index.tolist():
        for j in m.near(i).tolist():
            if m.tree[j] == m.tree[i]:
                continue
            k = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * k >= PERCENT * (len(sets[i]) + len(sets[j]) - k):
                out.append((m.nodes[i], m.nodes[j]))
                m.tree[m.tree == m.tree[j]] = m.tree[i]
    return out


def _sizes_fit():
    return 100 * F.least("n_shingles", "v_n_shingles") >= PERCENT * F.greatest("n_shingles", "v_n_shingles")


def _apart(name: str, i: int):
    return F.get(name, F.lit(i)).bitwiseXOR(F.get(f"v_{name}", F.lit(i)))


def _nibbles_agree():
    differ = []
    for i in range(NIBBLES // 16):
        x = _apart("nibbles", i)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))  # the lowest bit of four: whether any is set
        differ.append(F.bit_count(x.bitwiseAND(0x1111111111111111)))
    most = F.lit(MAY_DIFFER_ELSE)
    for total, limit in reversed(MAY_DIFFER):
        most = F.when(F.col("n_shingles") + F.col("v_n_shingles") <= total, limit).otherwise(most)
    return sum(differ[1:], differ[0]) <= most


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Null and empty texts have an empty set and are linked with nothing, and so are rows without an
    id (their component is null, and they are kept).  Rows with one id are one document.  An empty
    table gives no rows.  Columns other than ``doc_id`` and ``text`` are left out.
    """
    rows = stored(signed(docs), "signed")
    return _grouped(docs, rows)


def _grouped(docs: DataFrame, rows: DataFrame) -> DataFrame:
    nodes, roots = node_components(docs, rows)
    grouped = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # Only nodes that stand for several documents, or are linked, are needed beyond their own id.
    named = stored(grouped.join(first, "root").select("node", "component_id"), "named")
    joined = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; all columns stay.

    Of rows that repeat both id and text, one stays.
    """
    rows = stored(signed(docs), "signed")
    found = stored(_grouped(docs, rows), "grouped")
    (first,) = fresh(docs, "_first")
    known = found.where("doc_id IS NOT NULL").groupBy("doc_id")
    marks = known.agg(F.count("*").alias("n"), F.every("kept").alias(first)).where(F.expr("n > 1") | ~F.col(first))
    marks = stored(marks.drop("n"), "marked")
    if marks.count() <= FEW:  # Spark broadcasts them: no text is shuffled
        once = docs.join(marks.select("doc_id"), "doc_id", "left_anti")
        more = docs.join(marks.where(first).select("doc_id"), "doc_id", "left_semi")
    else:  # only texts are shuffled whose id is marked, or shares the bit of one that is
        asked, once = sifted(docs, marks.select("doc_id"))
        more = asked.join(marks, "doc_id", "left").where(F.coalesce(first, F.lit(True))).drop(first)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS node FROM words
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.node = edges.a),
component AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN component USING (doc_id)"""
