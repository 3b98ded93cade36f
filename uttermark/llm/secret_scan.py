"""Secrets in texts: strict patterns, and a battery of randomness tests.

Three patterns give the base spans.  Beyond them every run of 16 or more letters, digits and
``+/_-`` is a candidate, read in the smallest usual alphabet that holds it (its encoding).  Three
tests ask whether it can be a random draw from that alphabet: chi-squared for even use of the
symbols, runs above and below the middle of the alphabet, and serial correlation of neighbours.
A candidate that fails any is not random and no secret.

That alone proves nothing for short ones, so false discoveries are controlled against ordinary text:
all that stands outside candidates, and candidates that the battery rejects.  How often each symbol
occurs there, and each step between small letters, capitals, digits and marks, is counted; the
likelihood of the candidate as a random draw, over that as ordinary text, is evidence whose mean
under ordinary text is one, and which grows with length.  Per encoding and class of length, over distinct candidates,
those are kept whose evidence beats the number of candidates over those kept and the rate (the
e-value form of the Benjamini-Hochberg rule, which holds under any dependence).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.llm.common import stored

# The strict patterns, and the least length of a match (of its second group).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
RANDOM = "random"  # the kind of added spans

CANDIDATE = re.compile("[A-Za-z0-9+/_-]{16,}")  # holds all access and hex matches that are long enough
PADDING = re.compile("={1,2}")

_digits, _lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_upper = _lower.upper()
#: Encodings from small to large alphabets, symbols in the order of their values.
ENCODINGS = {
    "decimal": _digits,
    "hex": _digits + "abcdef",
    "hex_upper": _digits + "ABCDEF",
    "lower": _lower,
    "upper": _upper,
    "base32": _upper + "234567",
    "base36": _digits + _lower,
    "base36_upper": _digits + _upper,
    "letters": _upper + _lower,
    "base62": _upper + _lower + _digits,
    "base64": _upper + _lower + _digits + "+/",
    "base64url": _upper + _lower + _digits + "-_",
    "any": _upper + _lower + _digits + "+/-_",
}
NO_SECRET = "decimal"  # runs of digits are numbers

ALPHA = 0.001  # a random candidate fails the battery so often
RATE = 0.01  # of false discoveries
STEP, MOST = 10, 4000  # evidence is compared in steps of a tenth of a decimal order, to 10^400

#: Sorts of symbols: small letters, capitals, digits, marks; 4 is none of them.
SORTS = 5
_sort = np.full(256, 4, dtype=np.int64)
for _i, _symbols in enumerate((_lower, _upper, _digits, "+/-_")):
    _sort[np.frombuffer(_symbols.encode(), dtype=np.uint8)] = _i

_values = {}
for _name, _symbols in ENCODINGS.items():
    _values[_name] = np.full(256, -1, dtype=np.int64)
    _values[_name][np.frombuffer(_symbols.encode(), dtype=np.uint8)] = np.arange(len(_symbols))


def encoding(token: np.ndarray) -> str:
    """The smallest alphabet that holds all symbols (bytes) of a candidate."""
    return next(name for name, v in _values.items() if (v[token] >= 0).all())


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def uniformity(values: np.ndarray, k: int) -> float:
    """Probability of so uneven a use of k symbols, or more, by chance.

    Chi-squared over equal expectations is a linear function of the pairs of equal symbols; their
    exact mean and variance fit a gamma distribution (Wilson and Hilferty), also for short texts.
    """
    n, c = len(values), np.bincount(values, minlength=k)
    pairs, all_pairs = int((c * (c - 1)).sum()) // 2, n * (n - 1) / 2
    mean, var = all_pairs / k, all_pairs / k * (1 - 1 / k)
    spread = var / (9 * mean * mean)  # 2 / (9 nu) of the chi-squared with the same shape
    z = ((pairs / mean) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: np.ndarray, k: int) -> float:
    """Probability of a number of runs above and below the middle so far from its mean."""
    high = 2 * values >= k
    n, n1 = len(values), int(high.sum())
    n2 = n - n1
    if not n1 or not n2:
        return min(1.0, 2 * max(k // 2, k - k // 2) ** n / k**n)
    r = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * n1 * n2 / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var <= 0:
        return 1.0
    return _two_sided(max(0.0, abs(r - mean) - 0.5) / math.sqrt(var))


def serial(values: np.ndarray, k: int) -> float:
    """Probability of a correlation of neighbours so far from none."""
    x = values - (k - 1) / 2
    c = float((x[1:] * x[:-1]).sum()) / ((k * k - 1) / 12)
    return _two_sided(c / math.sqrt(len(values) - 1))


def looks_random(token: bytes) -> tuple[str, bool]:
    """Encoding of a candidate, and whether no test of the battery rejects a random draw from it."""
    t = np.frombuffer(token, dtype=np.uint8)
    name = encoding(t)
    if name == NO_SECRET:
        return name, False
    v, k = _values[name][t], len(ENCODINGS[name])
    return name, 3 * min(uniformity(v, k), runs(v, k), serial(v, k)) >= ALPHA


def base_spans(text: str, candidates: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the strict patterns; candidates are all runs of them."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((m.start(), 0, m.end()))
    for at, end in candidates:
        for rank, pattern in ((1, ACCESS), (2, HEX)):
            for m in pattern.finditer(text, at, end):
                if m.end() - m.start() >= LEAST[KINDS[rank]]:
                    out.append((m.start(), rank, m.end()))
    return sorted(out)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.binary()), ("encoding", pa.string()), ("random", pa.bool_())]))
_SPAN_TYPE = "array<struct<start:bigint,rank:int,end:bigint>>"
_FOUND_TYPE = "array<struct<start:bigint,end:bigint,token:binary,encoding:string,random:boolean>>"


def symbol_counts(text: np.ndarray) -> np.ndarray:
    """How often each byte occurs, then each step from one sort to another."""
    sort = _sort[text]
    steps = np.bincount(sort[:-1] * SORTS + sort[1:], minlength=SORTS * SORTS)
    return np.concatenate([np.bincount(text, minlength=256), steps])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ordinary = np.zeros(256 + SORTS * SORTS, dtype=np.int64)
    kind = None
    for batch in batches:
        kind = batch.schema.types[0]
        base, found = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            ordinary += symbol_counts(np.frombuffer(text.encode(), dtype=np.uint8))
            candidates = [m.span() for m in CANDIDATE.finditer(text)]
            spans = base_spans(text, candidates)
            base.append([{"start": s, "rank": r, "end": e} for s, r, e in spans])
            own = []
            for s, e in candidates:
                token = text[s:e].encode()
                name, random = looks_random(token)
                known = any(a < e and s < b for a, _, b in spans)
                if known or random:
                    ordinary -= symbol_counts(np.frombuffer(token, dtype=np.uint8))
                if not known:
                    pad = PADDING.match(text, e)
                    own.append({"start": s, "end": pad.end() if pad else e, "token": token, "encoding": name, "random": random})
            found.append(own)
        cols = [batch.column(0), pa.array(base, type=_SPAN), pa.array(found, type=_FOUND), pa.nulls(len(base), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "found", "ordinary"])
    if kind is not None:  # the last row of a task: what it counted
        cols = [pa.nulls(1, kind), pa.nulls(1, _SPAN), pa.nulls(1, _FOUND), pa.array([ordinary.tolist()], type=pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "found", "ordinary"])


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, base, found`` of every row, and rows with ``ordinary`` for what tasks counted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, base {_SPAN_TYPE}, found {_FOUND_TYPE}, ordinary array<bigint>"
    return stored(docs.select("doc_id", "text").mapInArrow(_scan, schema), "scanned")


class Evidence:
    """Log likelihood of a candidate as a random draw from its alphabet, over that as ordinary text:
    steps between the sorts of symbols, and symbols within their sort, as often as counted."""

    def __init__(self, counts: np.ndarray):
        seen, steps = counts[:256] + 1.0, counts[256:].reshape(SORTS, SORTS) + 1.0
        self.first, self.step, self.symbol = {}, {}, {}
        for name, symbols in ENCODINGS.items():
            at = np.frombuffer(symbols.encode(), dtype=np.uint8)
            of_sort = np.bincount(_sort[at], weights=seen[at], minlength=SORTS)
            here = of_sort > 0
            self.first[name] = np.where(here, np.log(of_sort.sum() / np.maximum(of_sort, 1)), 0)
            to = steps * here
            self.step[name] = np.where(here, np.log(to.sum(axis=1, keepdims=True) / np.maximum(to, 1)), 0)
            self.symbol[name] = np.zeros(256)
            self.symbol[name][at] = np.log(of_sort[_sort[at]] / seen[at] / len(at))

    def of(self, token: bytes, name: str) -> float:
        t = np.frombuffer(token, dtype=np.uint8)
        sort = _sort[t]
        return float(self.first[name][sort[0]] + self.step[name][sort[:-1], sort[1:]].sum() + self.symbol[name][t].sum())


def ordinary_text(scans: DataFrame) -> Evidence:
    rows = scans.where("ordinary IS NOT NULL").select(F.posexplode("ordinary").alias("i", "n"))
    counts = np.zeros(256 + SORTS * SORTS)
    for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect():  # one row per place of the array
        counts[r["i"]] = r["n"]
    return Evidence(counts)


def graded(evidence: Evidence, token: bytes, encoding: str, random: bool) -> tuple[str, int]:
    """Class and step of evidence of a candidate; what the battery rejected has none (step 0)."""
    e = evidence.of(token, encoding) if random else 0.0
    return f"{encoding}:{len(token).bit_length()}", int(min(MOST, max(0.0, STEP * e / math.log(10))))


def thresholds(counts: dict[tuple[str, int], int], rate: float = RATE) -> dict[str, int]:
    """Per class the least step of evidence that is a discovery; absent where there is none."""
    out: dict[str, int] = {}
    for kind in {k for k, _ in counts}:
        of = {step: n for (k, step), n in counts.items() if k == kind}
        tests, kept = sum(of.values()), 0
        for step in sorted((s for s in of if s), reverse=True):
            kept += of[step]
            if step / STEP >= math.log10(tests / (kept * rate)):
                out[kind] = step
    return out


def find(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, spans`` of every row: base spans and the random ones that were added.

    A span has ``start, rank, end``, in code points, rank naming its kind in ``KINDS`` or beyond
    them; spans are in the order of start and rank.  Null and empty texts have none; rows without
    an id and repeated rows are rows like others (a repeated candidate counts once in the rate).
    An empty table gives no rows.  Only ``doc_id`` and ``text`` are looked at.
    """
    scans = scanned(docs)
    evidence = ordinary_text(scans)
    rows = scans.where("ordinary IS NULL").select("doc_id", "base", "found")
    each = rows.select(F.explode("found").alias("f")).select("f.token", "f.encoding", "f.random").distinct()

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [graded(evidence, *x) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = [pa.array([x[i] for x in of], type=t) for i, t in enumerate((pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "step"])

    grades = each.mapInArrow(grade, "kind string, step int").groupBy("kind", "step").count()
    cut = thresholds({(r["kind"], r["step"]): r["count"] for r in grades.collect()}, rate)  # bounded by classes and steps

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = [(x["start"], x["rank"], x["end"]) for x in base]
                for x in found:
                    kind, step = graded(evidence, x["token"], x["encoding"], x["random"])
                    if step >= cut.get(kind, MOST + 1):
                        spans.append((x["start"], len(KINDS), x["end"]))
                out.append([{"start": s, "rank": r, "end": e} for s, r, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=_SPAN)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(add, f"doc_id {kind}, spans {_SPAN_TYPE}")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    line = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, line), ",")


def report(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their digest, and all spans as text.

    Cases are those of ``find``; without spans the digest is that of the empty string.
    """
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return find(docs, rate).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
