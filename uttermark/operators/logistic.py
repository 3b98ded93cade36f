"""Logistic regression on word counts for several cells at once, without a vector of words in one place.

The model is that of ``pyspark.ml``: counts of every word of a cell, standardised and centred, a
quadratic penalty, L-BFGS with a strong Wolfe search.  From zero weights on, all that L-BFGS adds up
are gradients, and a gradient is a sum of documents.  So weights are kept as coefficients of the
gradients so far, a few numbers a cell, and documents keep their margins under each gradient.  A step
sends the residuals of blocks of documents to blocks of words and takes margins back; its products of
gradients are sums over documents.  All cells take their steps in the same jobs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttermark.session import discard, sized

STEPS = 20
PENALTY = 0.01
TOLERANCE = 1e-6
HISTORY = 10
BLOCK = 1024  # documents of a block
WORDS = 1 << 23  # words in their places that a block of words has about
SHELF = 4  # blocks of words that a task of a step goes through
TOGETHER = 1 << 20  # entries that are added up at a time


class Cells:
    """The classes of the cells, and where a cell's classes stand among all columns."""

    def __init__(self, counts: list[dict[str | None, int]]):
        self.steps = STEPS
        self.labels, self.n, self.start, self.constant = [], [], [], []
        for count in counts:
            known = sorted((c for c in count if c is not None), key=lambda c: (-count[c], c))
            size = [*(count[c] for c in known), count.get(None, 0)]  # one class more for all others
            self.labels.append({c: i for i, c in enumerate(known)})
            self.n.append(sum(size))
            some = [i for i, x in enumerate(size) if x]
            self.constant.append(some[0] if len(some) == 1 else None)
            if len(size) == 2 and len(some) == 2:
                self.start.append(np.array([0, math.log(size[1] / size[0])]))
            else:
                logs = np.log1p(size)
                self.start.append(logs - logs.mean())
        self.k = [len(b) for b in self.start]
        ends = np.cumsum([0, *self.k])
        self.at = [slice(a, b) for a, b in zip(ends, ends[1:])]
        # Columns that travel: of two classes the second (the first has no weights), else all but the
        # last (residuals and weights of a word add up to zero); ``full`` gives all columns again.
        self.sent = [i for s, k in zip(self.at, self.k) for i in range(s.stop - 1 if k == 2 else s.start, s.stop - (k > 2))]
        self.cell = np.array([next(c for c, s in enumerate(self.at) if s.start <= i < s.stop) for i in self.sent], dtype=int)
        self.full = np.zeros((len(self.sent), ends[-1]))
        for row, (i, c) in enumerate(zip(self.sent, self.cell)):
            self.full[row, i] = 1
            if self.k[c] > 2:
                self.full[row, self.at[c].stop - 1] = -1

    def margins(self, seen: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
        """Margins under each cell's point, from those under the gradients (step, document, column)."""
        steps = len(seen)
        by = np.array([points[c][:steps] for c in self.cell]).reshape(len(self.sent), steps)
        some = np.einsum("tnc,ct->nc", seen, by)
        return some @ self.full + np.concatenate([p[self.steps + 1 :] for p in points])

    def losses(self, margins: np.ndarray, y: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The summed loss of each cell, and the residuals."""
        loss, rest = np.zeros(len(self.k)), np.zeros(margins.shape)
        for c, s in enumerate(self.at):
            m = margins[:, s] - margins[:, s].max(axis=1, keepdims=True)
            e = np.exp(m)
            total = e.sum(axis=1, keepdims=True)
            rows = np.arange(len(m))
            loss[c] = ((np.log(total[:, 0]) - m[rows, y[:, c]]) * member[:, c]).sum()
            e /= total
            e[rows, y[:, c]] -= 1
            rest[:, s] = e * member[:, c : c + 1]
            if self.k[c] == 2:
                rest[:, s.start] = 0
        return loss, rest


def _numbers(value, kind=np.float64) -> np.ndarray:
    return np.frombuffer(value, dtype=kind)


def _packed(value: np.ndarray, kind) -> bytes:
    return zstandard.compress(value.astype(kind).tobytes(), 1)


def _unpacked(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(value), dtype=kind)


@contextmanager
def _tidy(spark):
    """What the jobs in it shuffle is removed after each of them, not when the driver's memory is swept."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _document_blocks(docs: DataFrame, cells: Cells) -> DataFrame:
    """``b, y, member, test, seen``: a row for each block of documents, its arrays packed."""
    labels, k = cells.labels, cells.k

    def pack(table):
        table = table.sort_by("_no")
        y = [[of.get(c, n - 1) for of, n in zip(labels, k)] for c in table["class"].to_pylist()]
        return pa.table({
            "b": [table["_no"][0].as_py() // BLOCK],
            "y": [np.array(y, dtype=np.int32).tobytes()],
            "member": [np.array(table["member"].to_pylist(), dtype=np.uint8).tobytes()],
            "test": [np.array(table["test"].to_pylist(), dtype=np.uint8).tobytes()],
            "seen": [b""],
        })

    d = docs.select("_no", "class", "member", "test", F.expr(f"_no div {BLOCK}").alias("b"))
    return d.groupBy("b").applyInArrow(pack, "b long, y binary, member binary, test binary, seen binary")


_BAG = "w long, b long, member binary, data binary, size binary, place binary, word binary, n binary"


def _bags(docs: DataFrame, blocks: int) -> DataFrame:
    """``_BAG``: the words of a block of words that some documents of a block have.

    ``data`` and ``size`` are the different words, ``word`` is a number among them, ``place`` that of
    the document, ``n`` how often it has the word.  A block of documents may be in several rows.
    """

    def run(batches):
        for batch in batches:
            no = batch.column(0).to_numpy()
            cuts = [*np.flatnonzero(np.diff(no // BLOCK, prepend=-1)).tolist(), len(no)]
            for a, z in zip(cuts, cuts[1:]):
                yield from bags(no[a:z], batch.slice(a, z - a))

    def bags(no, batch):
        lists = batch.column(2)
        doc = np.repeat(np.arange(len(no)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        tokens = lists.flatten().dictionary_encode()
        known = tokens.indices.is_valid().to_numpy(zero_copy_only=False)
        code = tokens.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
        words = [t.encode() for t in tokens.dictionary.to_pylist()]
        if not len(code):
            return
        cell, n = np.unique(doc[known] * len(words) + code, return_counts=True)
        doc, code = cell // len(words), cell % len(words)
        member = np.zeros((BLOCK, len(batch.column(1)[0])), dtype=np.uint8)
        member[no % BLOCK] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(no), -1)
        member = _packed(np.packbits(member), np.uint8)
        w = np.array([xxhash.xxh3_64_intdigest(x) % blocks for x in words])
        order = np.argsort(w[code], kind="stable")
        ends = np.searchsorted(w[code[order]], np.arange(blocks + 1))
        out = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            at = order[ends[k] : ends[k + 1]]
            some, number = np.unique(code[at], return_inverse=True)
            texts = [words[c] for c in some.tolist()]
            size = np.array([len(x) for x in texts])
            place = (no[doc[at]] % BLOCK).astype(np.int64)
            out.append((
                k, int(no[0]) // BLOCK, member, zstandard.compress(b"".join(texts), 1), _packed(size, np.int32),
                _packed(place, np.int32), _packed(number, np.int32), _packed(n[at], np.int32),
            ))
        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.binary()) for f in _BAG.split(", ")])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select("_no", "member", "tokens").mapInArrow(run, _BAG)


def _word_blocks(docs: DataFrame, cells: Cells, blocks: int) -> DataFrame:
    """``w, b, place, word, n``: the counts of a block of words in a block of documents, packed.

    The row without ``b`` has the words' scales and means in each cell.  Blocks of words that share the
    shelf ``g`` are in one partition.
    """
    n = np.array(cells.n, dtype=float)

    def pack(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["b"], r["place"], r["word"]))
        numbers: dict[bytes, int] = {}
        out, held, many = [], [], 0
        total, square = np.zeros((0, len(n))), np.zeros((0, len(n)))

        def add():
            nonlocal total, square
            word, count, member = (np.concatenate(x) for x in zip(*held))
            grown = np.zeros((len(numbers) - len(total), len(n)))
            total, square = np.concatenate([total, grown]), np.concatenate([square, grown])
            for c in range(len(n)):
                total[:, c] += np.bincount(word, count * member[:, c], len(numbers))
                square[:, c] += np.bincount(word, count * count * member[:, c], len(numbers))

        for row in rows:
            data, ends = zstandard.decompress(row["data"]), np.cumsum(_unpacked(row["size"], np.int32)).tolist()
            known = np.array([numbers.setdefault(data[a:z], len(numbers)) for a, z in zip([0, *ends], ends)])
            place, count = _unpacked(row["place"], np.int32), _unpacked(row["n"], np.int32).astype(float)
            word = known[_unpacked(row["word"], np.int32)]
            member = np.unpackbits(_unpacked(row["member"], np.uint8))[: BLOCK * len(n)].reshape(BLOCK, len(n))
            out.append((key[0].as_py(), row["b"], row["place"], _packed(word, np.int32), row["n"]))
            held.append((word, count, member[place]))
            many += len(word)
            if many > TOGETHER:
                add()
                held, many = [], 0
        if held:
            add()
        mean = total / n
        spread = np.sqrt(np.maximum(square - n * mean * mean, 0) / np.maximum(n - 1, 1))
        scale = np.divide(1, spread, out=np.zeros_like(spread), where=spread > 1e-12)
        out.append((key[0].as_py(), None, scale.tobytes(), None, mean.tobytes()))
        return pa.table(dict(zip(("w", "b", "place", "word", "n"), map(list, zip(*out)))), schema=pa.schema([
            ("w", pa.int64()), ("b", pa.int64()), ("place", pa.binary()), ("word", pa.binary()), ("n", pa.binary()),
        ]))

    shelves = _shelves(docs, blocks)
    packed = _bags(docs, blocks).groupBy("w").applyInArrow(pack, "w long, b long, place binary, word binary, n binary")
    packed = packed.withColumn("g", F.pmod("w", F.lit(shelves).cast("long")))
    return packed.repartition(shelves, "g").sortWithinPartitions("g", "w", "b")


def _shelves(docs: DataFrame, blocks: int) -> int:
    """Residuals go to each shelf of blocks of words, so there are no more than tasks and memory need."""
    return min(blocks, max(docs.sparkSession.sparkContext.defaultParallelism, -(-blocks // SHELF)))


def _gradient(cells: Cells):
    """For a shelf of blocks of words: from residuals of all documents to their margins under the gradient."""
    columns, cell = len(cells.sent), cells.cell

    def run(key, x, rest):
        blocks = rest["b"].to_pylist()
        r = {b: _numbers(v.as_py()).reshape(-1, columns) for b, v in zip(blocks, rest["rest"])}
        out = {b: np.zeros(v.shape) for b, v in r.items()}
        shelf = defaultdict(list)
        for row in x.to_pylist():
            shelf[row["w"]].append(row)
        for w in sorted(shelf):
            block(shelf.pop(w), r, out)
        return pa.table({"b": pa.array(blocks, pa.int64()), "part": [out[b].tobytes() for b in blocks]})

    def block(rows, r, out):
        (about,) = [row for row in rows if row["b"] is None]
        scale, mean = (_numbers(about[name]).reshape(-1, len(cells.k)) for name in ("place", "n"))
        rows = [row for row in rows if row["b"] is not None]
        weight = -mean[:, cell] * sum(v.sum(axis=0) for v in r.values())
        held, many = [], 0
        for i, row in enumerate(rows):
            place, word, n = (_unpacked(row[name], np.int32) for name in ("place", "word", "n"))
            held.append((word, r[row["b"]][place] * n[:, None]))
            many += len(n)
            if many > TOGETHER or i + 1 == len(rows):
                word = np.concatenate([h[0] for h in held])
                value = np.concatenate([h[1] for h in held])
                for c in range(columns):
                    weight[:, c] += np.bincount(word, value[:, c], len(weight))
                held, many = [], 0
        centre = np.zeros(columns)
        for c, of in enumerate(cell):
            weight[:, c] *= scale[:, of] * scale[:, of]
            centre[c] = (mean[:, of] * weight[:, c]).sum()
        for v in out.values():
            v -= centre
        for row in rows:
            place, word, n = (_unpacked(row[name], np.int32) for name in ("place", "word", "n"))
            first = np.flatnonzero(np.diff(place, prepend=-1))
            out[row["b"]][place[first]] += np.add.reduceat(weight[word] * n[:, None], first, axis=0)

    return run


class _Blocks:
    """The packed arrays of a row of document blocks."""

    def __init__(self, row: dict, cells: Cells):
        self.y = _numbers(row["y"], np.int32).reshape(-1, len(cells.k))
        self.member = _numbers(row["member"], np.uint8).reshape(self.y.shape)
        self.test = _numbers(row["test"], np.uint8)
        self.seen = _numbers(row["seen"]).reshape(-1, len(self.y), len(cells.sent))


def _mapped(state: DataFrame, cells: Cells, schema: str, fn) -> DataFrame:
    """``fn`` gives the columns of ``schema`` from a row of document blocks."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                yield pa.RecordBatch.from_pydict(dict(zip(names, ([v] for v in fn(row, _Blocks(row, cells))))))

    return state.mapInArrow(run, schema)


def _sums(table: DataFrame, name: str) -> np.ndarray:
    """Sums of the places of an array column; their number is that of cells and steps."""
    e = table.select(F.posexplode(name).alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v"))
    return np.array([r.v for r in e.orderBy("p").collect()])


def _step(state: DataFrame, words: DataFrame, cells: Cells, points: list, blocks: int):
    """The state with the margins under the gradients at ``points``; losses, sums and products there."""

    def residuals(row, d):
        rest = cells.losses(cells.margins(d.seen, points), d.y, d.member)[1]
        return row["b"], np.ascontiguousarray(rest[:, cells.sent]).tobytes()

    def add(key, old, parts):
        row = old.to_pylist()[0]
        d = _Blocks(row, cells)
        new = sum(_numbers(p.as_py()) for p in parts["part"]).reshape(1, len(d.y), -1)
        loss, rest = cells.losses(cells.margins(d.seen, points), d.y, d.member)
        seen = np.concatenate([d.seen, new])
        products = np.einsum("nc,tnc->tc", rest @ cells.full.T, seen)
        figures = np.concatenate([loss, rest.sum(axis=0), products.ravel()])
        packed = {n: pa.array([row[n]], pa.binary()) for n in ("y", "member", "test")}
        return pa.table({"b": pa.array([row["b"]], pa.int64()), **packed, "seen": [seen.tobytes()], "figures": [figures.tolist()]})

    rest = _mapped(state, cells, "b long, rest binary", residuals)
    last = _shelves(state, blocks) - 1
    rest = rest.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("g"))
    parts = words.groupBy("g").cogroup(rest.groupBy("g")).applyInArrow(_gradient(cells), "b long, part binary")
    grown = state.groupBy("b").cogroup(parts.groupBy("b")).applyInArrow(
        add, "b long, y binary, member binary, test binary, seen binary, figures array<double>"
    )
    grown = sized(grown, "logistic")
    figures = _sums(grown, "figures")
    a, b = len(cells.k), len(cells.k) + cells.full.shape[1]
    products = figures[b:].reshape(-1, len(cells.sent))
    by_cell = np.array([products[:, cells.cell == c].sum(axis=1) for c in range(a)])
    return grown, figures[:a], figures[a:b], by_cell


def _along(state: DataFrame, cells: Cells, points: list, ways: list) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's loss at its point, and the slope of that in its direction."""

    def figures(row, d):
        loss, rest = cells.losses(cells.margins(d.seen, points), d.y, d.member)
        slope = (rest * cells.margins(d.seen, ways)).sum(axis=0)
        return [np.concatenate([loss, [slope[s].sum() for s in cells.at]]).tolist()]

    return tuple(_sums(_mapped(state, cells, "v array<double>", figures), "v").reshape(2, -1))


class SearchFailed(Exception):
    """No step is good enough."""


def _search(f: float, slope: float, t: float):
    """Strong Wolfe line search; yields steps, is sent values and slopes there, returns a step."""
    if slope > 0:
        raise SearchFailed
    low = (0.0, slope, f)

    def good(c):
        return abs(c[1]) <= 0.9 * abs(slope)

    def too_high(c):
        return c[2] > f + 1e-4 * c[0] * slope

    def zoom(low, high):
        for _ in range(10):
            d1 = low[1] + high[1] - 3 * (low[2] - high[2]) / (low[0] - high[0])
            d2 = math.sqrt(max(d1 * d1 - low[1] * high[1], 0))
            width = high[0] - low[0]
            at = high[0] - width * (high[1] + d2 - d1) / (high[1] - low[1] + 2 * d2)
            bounds = low[0] + 0.1 * width, low[0] + 0.9 * width
            at = bounds[0] if at < bounds[0] else bounds[1] if at > bounds[1] else at
            value, d = yield at
            c = (at, d, value)
            if too_high(c) or value >= low[2]:
                high = c
            else:
                if good(c):
                    return at
                if d * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed

    for i in range(10):
        value, d = yield t
        c = (t, d, value)
        if not math.isfinite(value):
            t /= 2
            continue
        if too_high(c) or (value >= low[2] and i):
            return (yield from zoom(low, c))
        if good(c):
            return t
        if d >= 0:
            return (yield from zoom(c, low))
        low = c
        t *= 1.5
    raise SearchFailed


def _descent(n: int, start: np.ndarray):
    """L-BFGS of one cell.  A vector is the coefficients of the gradients' document sums, and the
    intercepts.  Yields ``("at", point)`` for loss, intercept sums and products of the new sum with
    all, and ``("along", point, way)`` for loss and slope; returns the last point."""
    m = STEPS + 1
    gram = np.eye(m + len(start))
    gram[:m, :m] = 0
    x = np.concatenate([np.zeros(m), start])
    plain = np.arange(len(x)) < m

    def evaluate(t):
        loss, sums, products = yield ("at", x)
        gram[t, : t + 1] = gram[: t + 1, t] = products
        w = x * plain
        g = np.concatenate([np.zeros(m), sums / n]) + PENALTY * w
        g[t] += 1 / n
        return loss / n + PENALTY / 2 * (w @ gram @ w), g

    def norm(v):
        return math.sqrt(max(v @ gram @ v, 0))

    f, g = yield from evaluate(0)
    pairs, failed, step = [], False, 0
    while step < STEPS and norm(g) > max(TOLERANCE * f, 1e-8):
        way, used = g.copy(), []
        for s, y in pairs:
            rho = s @ gram @ y
            a = (s @ gram @ way) / rho
            way -= a * y
            used.append((a, rho))
        if pairs:
            way *= (pairs[0][0] @ gram @ pairs[0][1]) / (pairs[0][1] @ gram @ pairs[0][1])
        for (s, y), (a, rho) in zip(reversed(pairs), reversed(used)):
            way += (a - (y @ gram @ way) / rho) * s
        way = -way
        search = _search(f, g @ gram @ way, 1.0 if step else 1 / norm(way))
        try:
            t = next(search)
            while True:
                at = x + t * way
                loss, slope = yield ("along", at, way)
                w, v = at * plain, way * plain
                value = loss / n + PENALTY / 2 * (w @ gram @ w)
                t = search.send((value, slope / n + PENALTY * (w @ gram @ v)))
        except StopIteration as end:
            t = end.value
        except SearchFailed:
            if failed or not pairs:
                break
            failed, pairs = True, []
            continue
        x = x + t * way
        step += 1
        before = g
        f, g = yield from evaluate(step)
        pairs = [(t * way, g - before), *pairs][:HISTORY]
    return x


def _fit(state: DataFrame, words: DataFrame, cells: Cells, blocks: int) -> tuple[DataFrame, list]:
    """The points of all cells; cells of one class stay where they begin."""
    points = [np.concatenate([np.zeros(STEPS + 1), b]) for b in cells.start]
    runs = {c: _descent(cells.n[c], cells.start[c]) for c, only in enumerate(cells.constant) if only is None}
    asked = {c: next(run) for c, run in runs.items()}

    def answer(c, values):
        try:
            asked[c] = runs[c].send(values)
        except StopIteration as end:
            points[c] = end.value
            del asked[c]

    while asked:
        along = {c: q for c, q in asked.items() if q[0] == "along"}
        still = [np.zeros_like(p) for p in points]
        now = [asked[c][1] if c in asked else p for c, p in enumerate(points)]
        if along:
            ways = [along[c][2] if c in along else still[c] for c in range(len(points))]
            loss, slope = _along(state, cells, now, ways)
            for c in along:
                answer(c, (loss[c], slope[c]))
        else:
            old = state
            state, loss, sums, products = _step(state, words, cells, now, blocks)
            discard(old)
            for c in list(asked):
                s = sums[cells.at[c]]
                answer(c, (loss[c], s, products[c]))
    return state, points


def sweep(train: DataFrame, test: DataFrame, names: list[str]) -> DataFrame:
    """``cell, n_test, n_correct, accuracy`` of a fit per cell.

    ``train``: ``cells array<string>, class, tokens array<string>``; ``test``: ``class, tokens``.
    Classes that a cell has not seen, and missing ones, are one class more.
    """
    member = F.array(*[F.coalesce(F.array_contains("cells", c), F.lit(False)) for c in names])
    rows = train.select("class", "tokens", member.alias("member"), F.lit(False).alias("test"))
    rows = rows.where(F.exists("member", lambda m: m)).unionByName(
        test.select("class", "tokens", F.array(*[F.lit(False)] * len(names)).alias("member"), F.lit(True).alias("test"))
    )
    docs = sized(rows.withColumn("_no", F.monotonically_increasing_id()), "documents")
    seen = docs.where("NOT test").select("class", F.posexplode("member").alias("c", "m")).where("m")
    counts: dict[int, dict] = defaultdict(dict)
    for r in seen.groupBy("c", "class").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.c][r["class"]] = r.n
    if missing := [c for i, c in enumerate(names) if i not in counts]:
        raise ValueError(f"no training rows in the cells {missing}")
    cells = Cells([counts[i] for i in range(len(names))])
    places = docs.agg(F.sum(F.size(F.coalesce("tokens", F.array())))).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, 1 + places // WORDS)
    with _tidy(docs.sparkSession):
        words = _word_blocks(docs, cells, blocks).persist(StorageLevel.DISK_ONLY)
        words.count()
        state = sized(_document_blocks(docs, cells), "logistic")
        discard(docs)
        state, points = _fit(state, words, cells, blocks)
        words.unpersist()

    def score(row, d):
        margins = cells.margins(d.seen, points)
        right = []
        for c, s in enumerate(cells.at):
            said = margins[:, s].argmax(axis=1) if cells.constant[c] is None else cells.constant[c]
            right.append(int(((said == d.y[:, c]) & (d.test > 0)).sum()))
        return int(d.test.sum()), right

    scored = _mapped(state, cells, "n long, right array<long>", score)
    scored = scored.select("n", F.posexplode("right").alias("c", "k")).groupBy("c").agg(
        F.sum("n").alias("n_test"), F.sum("k").alias("n_correct")
    )
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("c") + 1)
    return scored.select(name.alias("cell"), "n_test", "n_correct", F.try_divide("n_correct", "n_test").alias("accuracy"))
