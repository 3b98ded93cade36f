"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded, a gated attention network gives it a
weight, the weighted sum of the encodings represents the document, and a logistic unit scores it.
Only the documents' labels are needed: which passages matter is learned with the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 48  # words
SAMPLE = 6000  # labelled documents at most that the model is fitted to, chosen by hash
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 60, 128, 0.01
THRESHOLD = 0.3
FOLDS = 5

# Classes of bytes: blanks, line ends, small and capital letters, digits, other marks, bytes of
# letters beyond ASCII, and each of these characters by itself.
SINGLE = b"#*$%&|<>!?.,:;\"'@/-_=()"
_class = np.full(256, 5, dtype=np.int64)
_class[[9, 11, 12, 32]] = 0
_class[[10, 13]] = 1
_class[ord("a") : ord("z") + 1] = 2
_class[ord("A") : ord("Z") + 1] = 3
_class[ord("0") : ord("9") + 1] = 4
_class[128:] = 6
_class[np.frombuffer(SINGLE, dtype=np.uint8)] = 7 + np.arange(len(SINGLE))
CLASSES = 7 + len(SINGLE)
PAIRS = 32  # cells for pairs of neighbouring bytes
STATISTICS = CLASSES + PAIRS + 3
WIDTH = STATISTICS + 1  # the last column says how much a passage's statistics tell
SURE_AT = 64  # bytes at which they count half
_places = np.random.default_rng(3).integers(1, 1 << 62, 64) | 1
_blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(text: str | None) -> np.ndarray:
    """One row of statistics per passage of the whole text; no words: one row of zeros."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    inside = ~_blank[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    word = np.cumsum(first)  # number of the word that a byte is in or after
    n = int(word[-1]) if len(word) else 0
    if not n:
        return np.zeros((1, WIDTH), dtype=np.float32)
    at = np.maximum(word - 1, 0) // PASSAGE
    count = int(at[-1]) + 1
    classes = np.bincount(at * CLASSES + _class[data], minlength=count * CLASSES).reshape(count, CLASSES)
    wide = data.astype(np.int64)
    cell = ((wide[:-1] * 131 + wide[1:]) * 2654435761 >> 16) % PAIRS
    pairs = np.bincount(at[:-1] * PAIRS + cell, minlength=count * PAIRS).reshape(count, PAIRS)
    size = np.maximum(classes.sum(axis=1, keepdims=True), 1)
    words = np.full((count, 1), PASSAGE, dtype=np.float64)
    words[-1] = n - PASSAGE * (count - 1)
    letters = np.maximum(size - classes[:, :2].sum(axis=1, keepdims=True), 1)
    # Words as sums of bytes times a factor by place; how many of a passage's words are distinct.
    begin = np.flatnonzero(first)
    place = np.arange(len(data)) - begin[np.maximum(word - 1, 0)]
    code = np.add.reduceat(np.where(inside, (wide + 1) * _places[place & 63], 0), begin)
    of_word = np.arange(n) // PASSAGE
    order = np.lexsort((code, of_word))
    new = np.ones(n, dtype=bool)
    new[1:] = (np.diff(code[order]) != 0) | (np.diff(of_word[order]) != 0)
    distinct = np.bincount(of_word[order], weights=new, minlength=count)[:, None] / words
    rows = [np.sqrt(classes / size), np.sqrt(pairs / size), np.log1p(words), np.log(letters / words), distinct]
    rows.append(size / (size + SURE_AT))
    return np.hstack(rows).astype(np.float32)


class Model:
    """Weights of encoder, gated attention and scorer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        scale = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.std = np.zeros(STATISTICS), np.ones(STATISTICS)
        self.shift = 0.0
        self.w = {
            "We": scale(STATISTICS, HIDDEN),
            "be": np.zeros(HIDDEN),
            "V": scale(HIDDEN, GATE),
            "U": scale(HIDDEN, GATE),
            "a": scale(GATE, 1),
            "c": scale(HIDDEN, 1),
            "d": np.zeros(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Logits of bags; ``starts`` is where each bag's rows begin."""
        w = self.w
        x = np.clip((x[:, :-1] - self.mean) / self.std, -8, 8) * x[:, -1:]
        h = np.tanh(x @ w["We"] + w["be"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = ((t * g) @ w["a"])[:, 0]
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        alpha = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(alpha[:, None] * h, starts)
        logit = (z @ w["c"])[:, 0] + w["d"][0]
        return logit, (x, h, t, g, alpha, z, bag)

    def gradient(self, x, starts, y):
        w = self.w
        logit, (x, h, t, g, alpha, z, bag) = self.forward(x, starts)
        error = (_sigmoid(logit) - y) / len(y)
        out = {"c": z.T @ error[:, None], "d": np.array([error.sum()])}
        dz = error[:, None] * w["c"].T
        dh = alpha[:, None] * dz[bag]
        dalpha = (h * dz[bag]).sum(axis=1)
        mean = np.add.reduceat(alpha * dalpha, starts)
        de = (alpha * (dalpha - mean[bag]))[:, None]
        out["a"] = (t * g).T @ de
        dtg = de @ w["a"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        out["V"], out["U"] = h.T @ dt, h.T @ dg
        dh += dt @ w["V"].T + dg @ w["U"].T
        dpre = dh * (1 - h * h)
        out["We"], out["be"] = x.T @ dpre, dpre.sum(axis=0)
        return out

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
        """Adam with weight decay; then the logit that best parts the sample becomes THRESHOLD."""
        rows = np.vstack(bags)[:, :-1]
        self.mean, self.std = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                ids = order[at : at + BATCH]
                x = np.vstack([bags[i] for i in ids])
                starts = np.cumsum([0, *[len(bags[i]) for i in ids[:-1]]])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in self.gradient(x, starts, labels[ids]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    size = (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                    self.w[k] = self.w[k] - rate * (size + 0.01 * self.w[k])
        logit = self.logits(bags)
        cut = best_cut(logit, labels) if 0 < labels.sum() < len(labels) else 0.0
        self.shift = np.log(THRESHOLD / (1 - THRESHOLD)) - cut
        return self

    def logits(self, bags: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(bags))
        at = 0
        while at < len(bags):
            end, size = at, 0
            while end < len(bags) and (end == at or size < 20_000):
                size += len(bags[end])
                end += 1
            group = bags[at:end]
            starts = np.cumsum([0, *[len(b) for b in group[:-1]]])
            out[at:end] = self.forward(np.vstack(group), starts)[0]
            at = end
        return out

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return _sigmoid(self.logits(bags) + self.shift)


def best_cut(logit: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap that parts the labels best, both counting alike."""
    order = np.argsort(logit)
    z, y = logit[order], labels[order]
    below = np.cumsum(1 - y)[:-1] / (1 - y).sum() - np.cumsum(y)[:-1] / y.sum()
    below[z[1:] == z[:-1]] = -1
    k = int(np.argmax(below))
    return float(z[k] + z[k + 1]) / 2


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents outside the held-out fold.

    The sample is chosen by the hash of the id, so reruns agree.  Ids with null or contradicting
    labels are left out; without any label the model scores all alike.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("y2"))
        .where("y = y2")
        .select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    schema = "doc_id long, y int, bag binary"

    def encoded(batches):
        for batch in batches:
            bags = [passages(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("y").cast(pa.int32()),
                    pa.array(bags, type=pa.binary()),
                ],
                names=["doc_id", "y", "bag"],
            )

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``sample`` ids
    rows = rows.select("doc_id", "y", "text").mapInArrow(encoded, schema).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["bag"]))
    if not rows:
        return Model()
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, WIDTH) for r in rows]
    return Model().fit(bags, np.array([r["y"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null and empty texts are a bag with one empty passage.  Rows are independent: repeated rows
    get equal scores, an empty table gives no rows; other columns than ``doc_id`` and ``text`` are
    left out, so language, source and labels cannot matter.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            bags = [passages(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(bags))], names=schema.names)

    scored = docs.select("doc_id", "text").mapInArrow(run, schema)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
