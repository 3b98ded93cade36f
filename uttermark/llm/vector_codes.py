"""Vectors compressed to one code per part: k-means with active entries.

A vector is cut into equal parts, and each part position has a codebook.  A round assigns every
part to the nearest entry and moves every entry to the mean of its parts.  Each part keeps its entry
and its exact distance from the round before.  Where that entry has not moved, distances to all
other entries at rest are known to be no better, so only the entries that moved (the active ones)
are compared with the stored distance; where it has moved, the part is compared with all.

A round is one pass: a task writes the new state of its rows and, as a last row for each part
position, what the parts that changed their entry add to the sums of the entries.  So sums are kept
by difference, and only codebooks (entries times the length of a vector) ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uttermark.llm.common import discard, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Whole numbers beyond this count as this, so that all arithmetic is exact in 64 bits.
LARGEST = 1 << 24
BLOCK = 4096  # parts compared together
EXACT = 1 << 53  # whole numbers below are exact as double


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x), exactly."""
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every part to every entry."""
    reach = int(np.abs(parts).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if parts.shape[1] * reach * reach < EXACT:  # then every intermediate sum is exact, too
        p, c = parts.astype(np.float64), entries.astype(np.float64)
        d = (p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (p @ c.T)
        return d.astype(np.int64)
    return np.stack([((parts - e) ** 2).sum(axis=1) for e in entries], axis=1)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each part; of entries equally near the first."""
    d = distances(parts, entries)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def reassigned(
    parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Entry and distance of each part, from those before the entries in ``moved`` moved."""
    code, dist = code.copy(), dist.copy()
    rescan = moved[code]
    if rescan.any():
        code[rescan], dist[rescan] = nearest_entries(parts[rescan], entries)
    active, rest = np.flatnonzero(moved), np.flatnonzero(~rescan)
    if len(active) and len(rest):
        best, d = nearest_entries(parts[rest], entries[active])
        best = active[best]
        better = (d < dist[rest]) | ((d == dist[rest]) & (best < code[rest]))
        code[rest[better]], dist[rest[better]] = best[better], d[better]
    return code, dist


def entry_sums(parts: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Per entry: sums of the components of its parts, and how many they are."""
    out = np.empty((entries, parts.shape[1] + 1), dtype=np.int64)
    for k in range(parts.shape[1]):
        out[:, k] = np.bincount(code, weights=parts[:, k], minlength=entries)
    out[:, -1] = np.bincount(code, minlength=entries)
    return out


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1), type=kind))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _round(books: np.ndarray, moved: np.ndarray | None, first: bool):
    """One pass over the rows; without ``moved`` all parts are compared with all entries."""
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, names = np.zeros((parts, entries, length + 1), dtype=np.int64), None
        for batch in batches:
            names, kinds = batch.schema.names[:2], batch.schema.types[:2]
            for at in range(0, len(batch), BLOCK):
                b = batch.slice(at, BLOCK)
                v = _matrix(b.column(2), parts * length)
                v = whole_numbers(v) if first else v.astype(np.int64)
                code = np.zeros((len(v), parts), dtype=np.int64) if first else _matrix(b.column(3), parts).astype(np.int64)
                dist = np.zeros((len(v), parts), dtype=np.int64) if first else _matrix(b.column(4), parts)
                now, error = np.empty_like(code), np.empty_like(code)
                for j in range(parts):
                    p = v[:, j * length : (j + 1) * length]
                    if moved is None:
                        now[:, j], error[:, j] = nearest_entries(p, books[j])
                    else:
                        now[:, j], error[:, j] = reassigned(p, books[j], moved[j], code[:, j], dist[:, j])
                    other = np.ones(len(v), dtype=bool) if first else now[:, j] != code[:, j]
                    if other.any():
                        change[j] += entry_sums(p[other], now[other, j], entries)
                        if not first:
                            change[j] -= entry_sums(p[other], code[other, j], entries)
                none = pa.nulls(len(v), pa.int32()), pa.nulls(len(v), pa.list_(pa.int64()))
                cols = [b.column(0), b.column(1), _lists(v.astype(np.int32), pa.int32()), _lists(now.astype(np.int32), pa.int32()), _lists(error, pa.int64()), *none]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *_STATE])
        told = np.flatnonzero(change.any(axis=(1, 2))).astype(np.int32)
        if len(told):
            n = len(told)
            cols = [pa.nulls(n, k) for k in (*kinds, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            cols += [pa.array(told), _lists(change[told].reshape(n, -1), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *_STATE])

    return run


_STATE = ["_v", "_code", "_dist", "_part", "_change"]


def _state_schema(rows: DataFrame) -> T.StructType:
    whole = T.ArrayType(T.IntegerType())
    kinds = [whole, whole, T.ArrayType(T.LongType()), T.IntegerType(), T.ArrayType(T.LongType())]
    own = [T.StructField(f.name, f.dataType) for f in rows.schema.fields[:2]]
    return T.StructType(own + [T.StructField(n, k) for n, k in zip(_STATE, kinds, strict=True)])


def _changes(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """What all tasks add to sums and counts; at most one number for each component of an entry."""
    out = np.zeros((shape[0], shape[1] * (shape[2] + 1)), dtype=np.int64)
    rows = state.where("_part IS NOT NULL").select("_part", F.posexplode("_change").alias("i", "x"))
    for r in rows.where("x != 0").groupBy("_part", "i").agg(F.sum("x").alias("x")).collect():
        out[r["_part"], r["i"]] = r["x"]
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``_id, _label, _x`` of the vectors that are not null and whose components are finite."""
    v = F.col(embedding)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), v.alias("_x"))
    return d.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _seeds(rows: DataFrame, entries: int) -> list:
    return rows.orderBy(F.col("_id").asc_nulls_last(), "_x").limit(entries).select("_x").collect()


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """``id, label, code, dist`` of every vector, and the codebooks (part, entry, component).

    Components are floor(1024 x), and beyond 2^24 count as 2^24.  A codebook starts as the parts
    of the vectors with the smallest ids (rows with one id in the order of their components, rows
    without an id last); with fewer vectors than entries it has as many entries as vectors.

    Vectors that are null or hold null or non-finite components are left out.  The first vector of a
    positive length divisible by ``parts``, in that order, sets the length; vectors of any other
    length are left out.  Rows without an id or a label take part; repeated rows all count.  An empty
    table gives no rows and codebooks without entries.  Other columns are not looked at.
    """
    rows = whole_vectors(vectors, vec_id, embedding, label)
    rows = rows.where((F.size("_x") > 0) & (F.size("_x") % parts == 0))
    seeds = _seeds(rows, entries)
    if not seeds:
        none = rows.select("_id", "_label", F.array().cast("array<int>").alias("_code"), F.array().cast("array<bigint>").alias("_dist"))
        return none, np.zeros((parts, 0, 0), dtype=np.int64)
    dim = len(seeds[0]["_x"])
    if any(len(s["_x"]) != dim for s in seeds):
        seeds = _seeds(rows.where(F.size("_x") == dim), entries)
    rows = rows.where(F.size("_x") == dim)
    start = whole_numbers(np.array([s["_x"] for s in seeds]))
    books = np.ascontiguousarray(start.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2))
    schema = _state_schema(rows)

    sums = np.zeros((*books.shape[:2], books.shape[2] + 1), dtype=np.int64)
    moved, state = None, None
    for r in range(rounds + 1):
        before = state
        source = rows if state is None else state.where("_part IS NULL")
        state = stored(source.mapInArrow(_round(books, moved, state is None), schema), f"codes-{r}")
        if before is not None:
            discard(before)  # no plan reads it any more
        if r == rounds:
            break
        sums += _changes(state, books.shape)
        count = sums[:, :, -1:]
        mean = sums[:, :, :-1] // np.maximum(count, 1)
        after = np.where(count > 0, mean, books)
        moved, books = (after != books).any(axis=2), after
    return state.where("_part IS NULL").select("_id", "_label", "_code", "_dist"), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _hex(code: Column, digits: int) -> Column:
    return F.array_join(F.transform(code, lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")


def report(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector ``compress`` keeps.

    Labels are equal where null, too.  A sum of errors beyond 64 bits is null.
    """
    state, books = compress(vectors, **options)
    digits = max(2, len(f"{max(0, books.shape[1] - 1):x}"))
    error = F.aggregate("_dist", F.lit(0).cast("long"), lambda a, x: a + x)
    d = state.select("_id", "_label", _hex(F.col("_code"), digits).alias("code"), error.alias("error"))
    total = stored(d.groupBy("_label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    total = total.withColumnRenamed("_label", "_of")
    d = d.join(total, F.col("_label").eqNullSafe(F.col("_of")))
    sha = F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    return d.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", sha)


def _rounds_sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS (SELECT vec_id, j, min({{'d': list_inner_product(p, p) - 2 * list_inner_product(p, c) + list_inner_product(c, c), 'e': e}}) AS b,
  any_value(p) AS p FROM parts JOIN b{r} USING (j) GROUP BY vec_id, j)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS (SELECT j, e, list(floor(s / n) ORDER BY i) AS c FROM (
  SELECT j, e, i, sum(x) AS s, count(*) AS n FROM (
    SELECT j, b.e AS e, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM a{r}) GROUP BY j, e, i) GROUP BY j, e),
b{r + 1} AS (SELECT j, e, coalesce(s{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN s{r} USING (j, e))""")
    return ",".join(steps)


CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, j, v[j * (len(v) // {PARTS}) + 1 : (j + 1) * (len(v) // {PARTS})] AS p
  FROM kept, (SELECT unnest(range({PARTS})) AS j)),
b0 AS (
  SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, p AS c FROM parts
  QUALIFY row_number() OVER (PARTITION BY j ORDER BY vec_id) <= {ENTRIES}),{_rounds_sql()},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY j) AS code, CAST(sum(b.d) AS BIGINT) AS error
  FROM a{ROUNDS} JOIN kept USING (vec_id) GROUP BY vec_id, label),
books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j, e, i)) AS codebooks_sha256
  FROM (SELECT j, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books"""
