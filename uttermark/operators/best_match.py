"""The best score of each text over all originals, exactly, with few pairs scored.

Originals are dealt into shards, and in a shard sorted by length and cut into blocks.  A block knows
its range of lengths and, for every n-gram, the largest count in any of its texts.  What a candidate
shares with these counts bounds its score against the whole block, so blocks are taken from the
highest bound down until the bound no longer beats the best score found: most are never opened.  In
an open block the same bound is taken per original before a pair is scored.

Candidates are dealt into chunks of bounded size.  A task holds one chunk, and shards pass by one
after the other, each text keeping its best score.  No pair is ever a row, no token is a join key,
and copies of one text are one text.  Texts are shuffled as they are and cut into tokens in the
task, where only the different runs between ASCII spaces are cut; all measures are taken in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 32  # originals
SHARD = 1 << 18  # tokens of originals that pass by together
CHUNK = 1 << 21  # tokens of candidates that one task holds
BYTES = 5  # of a token and what parts it from the next
BOUNDS = 1 << 22  # tokens times blocks whose bounds are taken together
LONG = 2000  # words of a text
TOGETHER = 64  # texts of about a length that are moved on together
SLACK = 1e-9
SPACES = r"[\t-\r \p{Z}]+"


def _grams(tokens: list[str], orders: int) -> Counter:
    """N-grams up to an order with their counts; one of order 1 is the token itself."""
    out = Counter(tokens)
    for n in range(2, orders + 1):
        out.update(zip(*[tokens[i:] for i in range(n)], strict=False))
    return out


class Originals:
    """The texts of one shard, in blocks."""

    def __init__(self, texts: list[list[str]], orders: int):
        self.orders = orders
        self.texts = sorted(texts, key=len)
        counts = [_grams(t, orders) for t in self.texts]
        each = sorted(dict.fromkeys(g for c in counts for g in c), key=lambda g: 1 if isinstance(g, str) else len(g))
        self.number: dict = {g: i for i, g in enumerate(each)}  # by order
        self.words = [[self.number[w] for w in t] for t in self.texts]
        self.longer = []  # per order from 2: which n-gram an n-gram and the word after it make
        for k in range(2, orders + 1):
            made = [(self.number[g[0] if k == 2 else g[:-1]] * len(each) + self.number[g[-1]], i) for g, i in self.number.items() if not isinstance(g, str) and len(g) == k]
            made = np.array(sorted(made), dtype=np.int64).reshape(-1, 2)
            self.longer.append((made[:, 0], made[:, 1]))
        self.order = np.array([0 if isinstance(g, str) else len(g) - 1 for g in self.number], dtype=np.int64)
        self.length = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.starts = list(range(0, len(self.texts), BLOCK))
        self.grams, self.counts = [], []  # of each block: its n-grams, and a row of counts for each
        for at in self.starts:
            ids = [(self.number[g], i, n) for i, c in enumerate(counts[at : at + BLOCK]) for g, n in c.items()]
            ids = np.array(ids, dtype=np.int64).reshape(-1, 3)
            grams, row = np.unique(ids[:, 0], return_inverse=True)
            table = np.zeros((len(grams), min(BLOCK, len(self.texts) - at)), dtype=np.int32)
            table[row, ids[:, 1]] = ids[:, 2]
            self.grams.append(grams)
            self.counts.append(table)
        # All blocks' largest counts, by n-gram.
        sizes = [len(g) for g in self.grams]
        gram = np.concatenate([*self.grams, np.zeros(0, dtype=np.int64)])
        block = np.repeat(np.arange(len(sizes)), sizes)
        most = np.concatenate([*(t.max(axis=1) for t in self.counts), np.zeros(0, dtype=np.int32)])
        by = np.argsort(gram, kind="stable")
        self.block, self.most = block[by], most[by]
        self.begin = np.searchsorted(gram[by], np.arange(len(self.number) + 1))

    def known(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts one after the other (their words' numbers, -1 for words no original has, and their
        sizes): text, n-gram and count of the n-grams that any original has, in order."""
        text, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
        at = np.flatnonzero(words >= 0)
        ids = words[at]
        found = [text[at] * len(self.number) + ids]
        for k, (keys, made) in enumerate(self.longer, start=1):
            more = at + k < end[at]
            at, ids = at[more], ids[more]
            after = words[at + k]
            key = ids * len(self.number) + after
            place = np.searchsorted(keys, key)
            hit = (after >= 0) & (place < len(keys))
            hit[hit] = keys[place[hit]] == key[hit]
            at, ids = at[hit], made[place[hit]]
            found.append(text[at] * len(self.number) + ids)
        both, counts = np.unique(np.concatenate(found), return_counts=True)
        return *np.divmod(both, max(1, len(self.number))), counts

    def shared_with_blocks(self, texts: int, text: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per text, block and order at least as many n-grams as any of the block's originals shares."""
        begin, size = self.begin[ids], self.begin[ids + 1] - self.begin[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
        least = np.minimum(np.repeat(counts, size), self.most[place])
        cell = (np.repeat(text, size) * len(self.starts) + self.block[place]) * self.orders + np.repeat(self.order[ids], size)
        n = texts * len(self.starts) * self.orders
        return np.bincount(cell, weights=least, minlength=n).reshape(-1, self.orders)

    def shared_within(self, block: int, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Per original of a block and order how many n-grams it shares."""
        grams = self.grams[block]
        at = np.searchsorted(grams, ids)
        hit = at < len(grams)
        hit[hit] = grams[at[hit]] == ids[hit]
        least = np.minimum(self.counts[block][at[hit]], counts[hit][:, None])
        if self.orders == 1:
            return least.sum(axis=0)[:, None]
        cuts = np.searchsorted(self.order[ids[hit]], np.arange(self.orders + 1))
        return np.stack([least[i:j].sum(axis=0) for i, j in zip(cuts, cuts[1:], strict=False)], axis=1)


class _Places(dict):
    """The places of each word of a text, as bits; of a long text made when asked for."""

    def __init__(self, words: np.ndarray):
        self.size, self.words = len(words), words
        if self.size <= LONG:
            for i, w in enumerate(words.tolist()):
                self[w] = self.get(w, 0) | 1 << i

    def __missing__(self, word: int) -> int:
        bits = 0
        if self.size > LONG:
            bits = int.from_bytes(np.packbits(self.words == word, bitorder="little").tobytes(), "little")
        self[word] = bits
        return bits


class RougeL:
    """F1 of the longest common subsequence; at most the shared tokens can be common."""

    orders = 1
    exact = False  # for one original the bound is the score

    @staticmethod
    def bound(shared: np.ndarray, m: int, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
        u = shared[:, 0]
        n = np.clip(u, shortest, longest)  # the length that suits so many shared tokens best
        return np.where(u > 0, 2 * np.minimum(u, n) / np.maximum(m + n, 1), 0.0)

    @staticmethod
    def score(places: _Places, m: int, original: list[int], shared: np.ndarray) -> float:
        full = v = (1 << places.size) - 1
        for t in original:
            if hit := places[t]:
                u = v & hit
                v = ((v + u) | (v - u)) & full
        return 2 * (places.size - v.bit_count()) / (m + len(original)) if m or original else 0.0

    @staticmethod
    def block_best(shard: Originals, block: int, words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best score of each text in a block of originals of up to 64 words, all of it at once: a
        row of bits per text and original, moved on by one word of every text at a time."""
        at = shard.starts[block]
        texts, n = shard.words[at : at + BLOCK], shard.length[at : at + BLOCK]
        grams = shard.grams[block]
        hits = np.zeros((len(grams) + 1, len(texts)), dtype=np.uint64)  # the last row: a word not in the block
        for i, t in enumerate(texts):
            for j, row in enumerate(np.searchsorted(grams, t).tolist()):
                hits[row, i] |= np.uint64(1 << j)
        row = np.full(len(shard.number) + 1, -1, dtype=np.int64)
        row[grams] = np.arange(len(grams))
        out = np.zeros(len(size))
        by = np.argsort(size, kind="stable")
        for group in np.array_split(by, range(TOGETHER, len(by), TOGETHER)):
            place = np.arange(size[group].sum())
            text = np.repeat(np.arange(len(group)), size[group])
            first = np.cumsum(size[group]) - size[group]
            rows = row[words[place - first[text] + starts[group][text]]]  # a word no original has is -1 as well
            text, rows = text[rows >= 0], rows[rows >= 0]
            many = np.bincount(text, minlength=len(group))
            steps = np.full((int(many.max(initial=0)), len(group)), len(grams), dtype=np.int64)
            steps[np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many), text] = rows
            v = np.full((len(group), len(texts)), np.iinfo(np.uint64).max)
            for step in steps:
                m = hits[step]
                u = v & m
                m = v - u
                v += u
                v |= m
            common = 64 - np.bitwise_count(v).astype(np.int64)  # bits past an original's end stay set
            out[group] = (2 * common / (size[group][:, None] + n)).max(axis=1)
        return out

    @staticmethod
    def cleaned(texts: pa.Array) -> pa.Array:
        return texts

    @staticmethod
    def cut(word: str) -> list[str]:
        return _ROUGE.findall(word.lower())


class Bleu4:
    """Sentence BLEU-4 (0 to 100): effective order, exponential smoothing.

    It rises with every shared count and falls with the original's length, so counts and lengths of
    a block bound all four orders at once; for one original the bound is the score.
    """

    orders = 4
    exact = True

    @staticmethod
    def bound(shared: np.ndarray, m: int | np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> np.ndarray:
        logs, zeros = np.zeros(len(shared)), np.zeros(len(shared))
        for i in range(4):
            total = np.maximum(m - i, 1)
            hit = np.where(m > i, np.minimum(shared[:, i], total), total)  # an order that is too long counts 1
            zeros += hit == 0
            logs += np.log(np.where(hit > 0, hit, 0.5**zeros) / total)
        m = np.maximum(m, 1)
        brevity = np.where(m < shortest, np.exp(1 - np.maximum(shortest / m, 1)), 1.0)
        return np.where(shared[:, 0] > 0, 100 * brevity * np.exp(logs / np.minimum(m, 4)), 0.0)

    @staticmethod
    def cleaned(texts: pa.Array) -> pa.Array:
        """What the mteval 13a tokeniser does across spaces."""
        t = pc.replace_substring_regex(texts, SPACES + "$", "")
        for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            t = pc.replace_substring(t, old, new)
        return t

    @staticmethod
    def cut(word: str) -> list[str]:
        """What it does between ASCII spaces: no rule looks beyond one."""
        if word.isalnum():
            return [word]
        for rule, new in _RULES:
            word = rule.sub(new, word)
        return word.split(" ") if word.isascii() else _SEPARATORS.split(word)


_SEPARATORS = re.compile("[ \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ROUGE = re.compile("[a-z0-9]+")
#: A space stands for the ends of the word, which the rules take for letters.
_RULES = [
    (re.compile("^|$"), " "),
    (re.compile(r"([{-~\[-` -&(-+:-@/])"), r" \1 "),
    (re.compile(r"([^0-9])([.,])"), r"\1 \2 "),
    (re.compile(r"([.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def best_in(shard: Originals, measure, tokens: list[str], floor: float) -> tuple[float, int]:
    """The best score of a text in a shard, or the floor if that is higher; and the pairs scored."""
    words = np.array([shard.number.get(t, -1) for t in tokens], dtype=np.int64)
    best = np.array([floor])
    scored = raise_to_best(shard, measure, words, np.array([len(words)]), best)
    return float(best[0]), scored


def raise_to_best(shard: Originals, measure, words: np.ndarray, size: np.ndarray, best: np.ndarray, together: bool = False) -> int:
    """Raises each text's best score to its best in a shard; the pairs scored one by one.

    ``words``: the words' numbers of texts one after the other, ``size``: how many each has.
    ``together``: the texts that open a block are scored against all of it at once where the measure can.
    """
    scored, blocks = 0, len(shard.starts)
    if not blocks:
        return 0
    text, ids, counts = shard.known(words, size)
    begin, starts = np.searchsorted(text, np.arange(len(size) + 1)), np.cumsum(size) - size
    last = np.minimum(np.array(shard.starts) + BLOCK, len(shard.texts)) - 1
    low, high = (np.tile(shard.length[x], len(size)) for x in (shard.starts, last))
    bounds = measure.bound(shard.shared_with_blocks(len(size), text, ids, counts), np.repeat(size, blocks), low, high)
    bounds = bounds.reshape(-1, blocks)
    if together and not measure.exact:
        short = shard.length[last] <= 64
        order = np.argsort(np.where(short, -bounds, 1), axis=1, kind="stable")
        for rank in range(int(short.sum())):
            block = order[:, rank]
            wanted = bounds[np.arange(len(size)), block] > best + SLACK
            if not wanted.any():
                break
            for b in np.unique(block[wanted]).tolist():
                x = np.flatnonzero(wanted & (block == b))
                best[x] = np.maximum(best[x], measure.block_best(shard, b, words, starts[x], size[x]))
        bounds[:, short] = 0
    for x in np.flatnonzero(bounds.max(axis=1) > best + SLACK).tolist():
        mine, n, m, floor, ready = ids[begin[x] : begin[x + 1]], counts[begin[x] : begin[x + 1]], int(size[x]), float(best[x]), None
        for b in np.argsort(-bounds[x], kind="stable").tolist():
            if bounds[x, b] <= floor + SLACK:
                break
            at = shard.starts[b]
            shared = shard.shared_within(b, mine, n)
            length = shard.length[at : at + len(shared)]
            each = measure.bound(shared, m, length, length)
            if measure.exact:
                floor, scored = max(floor, float(each.max())), scored + 1
                continue
            for i in np.argsort(-each, kind="stable").tolist():
                if each[i] <= floor + SLACK:
                    break
                if ready is None:  # words that no original has are no part of what is common
                    own = words[starts[x] : starts[x] + m]
                    ready = _Places(own[own >= 0])
                floor = max(floor, measure.score(ready, m, shard.words[at + i], shared[i]))
                scored += 1
        best[x] = floor
    return scored


class Texts:
    """The tokens of many texts as numbers; only different runs between spaces are cut."""

    def __init__(self, texts: pa.Array, measure):
        parts = pc.ascii_split_whitespace(measure.cleaned(texts))
        coded = parts.values.dictionary_encode()
        number: dict[str, int] = {}
        cuts = [[number.setdefault(t, len(number)) for t in measure.cut(w) if t] for w in coded.dictionary.to_pylist()]
        self.tokens = list(number)
        many = np.array([len(c) for c in cuts], dtype=np.int64)
        flat = np.array([i for c in cuts for i in c], dtype=np.int32)
        run = coded.indices.to_numpy()
        size = many[run]
        ends = np.cumsum(size)
        first = (np.cumsum(many) - many)[run]
        self.codes = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        self.ends = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        self.size = np.diff(self.ends)

    def lists(self) -> list[list[str]]:
        return [[self.tokens[i] for i in self.codes[a:b].tolist()] for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]

    def raise_to_best(self, shard: Originals, measure, best: np.ndarray) -> None:
        """Raises the scores so far to the best in the shard, a group of texts at a time."""
        number = np.array([shard.number.get(t, -1) for t in self.tokens] or [-1], dtype=np.int64)
        at, most = 0, max(1, BOUNDS // max(1, len(shard.starts)))
        while at < len(self.size):
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + most, side="right")) - 1)
            to = min(to, at + 1 + most // 64)
            words = number[self.codes[self.ends[at] : self.ends[to]]]
            raise_to_best(shard, measure, words, self.size[at:to], best[at:to], together=True)
            at = to


def _id(text: str) -> Column:
    """A digest of the text, so that copies are one text."""
    return F.unhex(F.md5(F.col(text)))


def _distinct(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``{prefix}id, {prefix}text`` of the different texts."""
    once = df.where(F.col(text).isNotNull()).groupBy(_id(text).alias(f"{prefix}id"))
    return once.agg(F.first(text).alias(f"{prefix}text"))


def _pieces(df: DataFrame, text: str, most: int) -> int:
    """How many pieces of at most about so many tokens the texts make."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return math.ceil(total / BYTES / most)


def _dealt(key: str, pieces: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(max(1, pieces)))


def best_match(cands: DataFrame, originals: DataFrame, key: str, text: str, measures: dict[str, type]) -> DataFrame:
    """``key`` and for each name of a measure the highest score of the candidate over all originals.

    Every row of ``cands`` gives a row.  Null and empty texts, and texts that share nothing with any
    original, score 0; so do all if there are no originals.
    """
    wide = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(wide, _pieces(cands, text, CHUNK))
    shards = _distinct(originals, text, "o").groupBy(_dealt("oid", _pieces(originals, text, SHARD)).alias("shard"))
    shards = shards.agg(F.collect_list("otext").alias("originals"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))  # every shard visits every chunk
    rows = _distinct(cands, text, "c").select(
        _dealt("cid", chunks).alias("chunk"), F.lit(-1).cast("long").alias("shard"), "cid", "ctext",
        F.lit(None).cast("array<string>").alias("originals"),
    ).unionByName(shards.select(chunk.alias("chunk"), "shard", F.lit(None).cast("binary").alias("cid"), F.lit(None).cast("string").alias("ctext"), "originals"))
    rows = rows.repartition(chunks, "chunk").sortWithinPartitions("chunk", "shard")
    names = list(measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, texts, held, best = None, [], [], None, None

        def told() -> pa.RecordBatch:
            scores = best if held else [np.zeros(len(ids))] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(ids, type=pa.binary()), *map(pa.array, scores)], names=["cid", *names])

        for batch in batches:
            for i, c in enumerate(batch.column(0).to_pylist()):
                if c != at:
                    if ids:
                        yield told()
                    at, ids, texts, held = c, [], [], None
                if batch.column(1)[i].as_py() < 0:
                    ids.append(batch.column(2)[i].as_py())
                    texts.append(batch.column(3)[i].as_py())
                elif ids:
                    if held is None:  # all texts of the chunk are here
                        given = pa.array(texts, type=pa.large_string())
                        held, texts = [Texts(given, m) for m in measures.values()], []
                        best = [np.zeros(len(ids)) for _ in names]
                    against = pa.array(batch.column(4)[i].as_py(), type=pa.large_string())
                    for h, m, b in zip(held, measures.values(), best, strict=True):
                        shard = Originals([t for t in Texts(against, m).lists() if t], m.orders)
                        h.raise_to_best(shard, m, b)
        if ids:
            yield told()

    best = rows.mapInArrow(run, "cid binary, " + ", ".join(f"{n} double" for n in names))
    out = cands.select(key, _id(text).alias("cid")).join(best, "cid", "left")
    return out.select(key, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
