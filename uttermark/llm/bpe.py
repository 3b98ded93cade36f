"""Byte-pair encoding by backtracking, and decoding through an offset table.

The encoder takes at each place the longest vocabulary entry (all matches come from one
Aho-Corasick pass) and keeps it only if the pair with the token before it is one that merging
would leave apart.  If no entry fits, it steps back.  A place that once proved a dead end is
never tried again, so the work is linear in the word, and the result is that of the merges.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Stretches whose tokens one worker remembers; when twice as many are there, those not used since go.
REMEMBERED = 100_000
PAIRS = 250_000  # pairs of tokens that a worker remembers
TOGETHER = 256  # texts that a worker holds in all their forms at a time


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level word vocabulary with an end-of-word mark, read from a tokenizer file.

    Inside, each byte is one symbol, and a byte that ends a word is another one.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        mark = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        of_letter = {c: i for i, c in enumerate(letters)}

        def symbols(token: str) -> str:
            last = bool(mark) and token.endswith(mark)
            body = [of_letter[c] for c in (token[: -len(mark)] if last else token)]
            return "".join(chr(b + (256 if last and i == len(body) - 1 else 0)) for i, b in enumerate(body))

        vocab = model["vocab"]
        self.id_of = {symbols(t): i for t, i in vocab.items()}
        self.length = {i: len(s) for s, i in self.id_of.items()}
        # Rank and halves of each merged token; merging a pair of ranks below wins first.
        self.merge, self.halves = {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merge[self.id_of[a], self.id_of[b]] = rank
            self.halves[self.id_of[a + b]] = (rank, self.id_of[a], self.id_of[b])
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.id_of.items():
            self.finder.add_word(s, i)
        self.finder.make_automaton()
        # The next shorter entry that a token's text begins with.
        self.shorter = {}
        for s, i in self.id_of.items():
            heads = (self.id_of.get(s[:k], -1) for k in range(len(s) - 1, 0, -1))
            self.shorter[i] = next((h for h in heads if h >= 0), -1)
        self.compatible: dict[tuple[int, int], bool] = {}

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # The file's pattern and letter case are applied here for letters that all Unicode versions
        # agree on; texts with younger ones leave normal form and word borders to the library.
        self.whole = Tokenizer.from_file(path)
        self.letters = {c: i for i, c in enumerate(letters)}
        self.young = re.compile(_young_letters())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])

        size = max(max(vocab.values()), *self.special.values()) + 1
        names = [b""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            names[i] = t.encode() + b" "
        self.text = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.offset = np.zeros(size + 1, dtype=np.int64)
        np.cumsum([len(n) for n in names], out=self.offset[1:])
        self.known = self.chunks = _Memory(self._chunk)  # of words and of what stands between blanks

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives back just these two."""
        if len(self.compatible) > PAIRS:
            self.compatible.clear()
        found = self.compatible[left, right] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        # Undo the tokens, latest merge first, and look at the two pieces that meet at the border:
        # had they a merge of their own before either was merged further, the border would be gone.
        # Of two overlapping places with one rank the left one is merged first.
        a, b = left, right
        until_a = until_b = len(self.merge)
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < until_a and rank <= until_b:
                return False
            rank_a, _, end_a = self.halves.get(a, (-1, 0, 0))
            rank_b, start_b, _ = self.halves.get(b, (-1, 0, 0))
            if rank_a > rank_b:
                until_a, a = rank_a, end_a
            elif rank_b >= 0:
                until_b, b = rank_b, start_b
            else:
                return True

    def encode_word(self, data: bytes) -> list[int]:
        """Tokens of one word."""
        if not data:
            return []
        s = data[:-1].decode("latin-1") + chr(256 + data[-1])
        if (whole := self.id_of.get(s)) is not None:
            return [whole]
        n, length, shorter, longest = len(s), self.length, self.shorter, self.finder.iter_long
        compatible = self.compatible
        out: list[int] = []
        dead: set[int] = set()  # places that no token sequence leads on from
        follow = longest(s)  # goes on by itself behind each longest entry
        at, left, cut, token = 0, -1, False, next(follow)[1]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if left < 0:
                        break
                    fits = compatible.get((left, token))
                    if fits is None:
                        fits = self.fits(left, token)
                    if fits:
                        break
                token, cut = shorter[token], True
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, left = end, token
                if cut:
                    follow, cut = longest(s, at), False
                token = next(follow)[1]
            else:  # nothing may follow here: give up this place and shorten the token before
                dead.add(at)
                token = out.pop()
                at -= length[token]
                left = out[-1] if out else -1
                token, cut = shorter[token], True

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts, at = [], 0
        if self.special_split is not None:
            for m in self.special_split.finditer(text):
                parts.append(self._plain(text[at : m.start()]))
                parts.append(self.special[m.group()].to_bytes(4, "little"))
                at = m.end()
        parts.append(self._plain(text[at:] if at else text))
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        # No word holds a blank, and no letter changes next to one, so the text may be cut there.
        known = self.known
        found = b"".join([known[c] for c in text.replace("\n", " ").split(" ")])
        if len(known) > REMEMBERED:
            known.turn()
        return found

    def _chunk(self, text: str) -> bytes:
        plain = text
        if not text.isascii():
            if self.young.search(text):
                return self._by_library(text)
            plain = unicodedata.normalize("NFC", text)
            plain = plain.replace("Σ", "σ")  # lower case letter by letter, without final sigma
        plain = plain.lower()
        words = [plain] if plain.isascii() and plain.isalpha() else self.words.findall(plain)
        if words == [text]:
            return self._word(text)
        # A word cut from a chunk is, as a chunk, that word alone, so one memory serves both.
        known = self.known
        return b"".join([known[w] for w in words])

    def _word(self, word: str) -> bytes:
        ids = array("I", self.encode_word(word.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _by_library(self, text: str) -> bytes:
        words = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return b"".join([self._word(bytes(map(self.letters.get, w)).decode()) for w, _ in words])

    def decode(self, ids: bytes) -> str:
        """The tokens' texts with blanks between them, gathered through the offset table."""
        if not ids:
            return ""
        idx = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        start = self.offset[idx]
        sizes = self.offset[idx + 1] - start
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(start - (ends - sizes), sizes)
        return self.text[place][:-1].tobytes().decode("utf-8", "replace")


def _young_letters() -> str:
    """A pattern for characters that Unicode 3.2 did not have yet."""
    old = unicodedata.ucd_3_2_0.category
    young = [c for c in range(0x80, 0x110000) if old(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(young) if not i or young[i - 1] != c - 1]
    ends = [c for i, c in enumerate(young) if i + 1 == len(young) or young[i + 1] != c + 1]
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]"


class _Memory(dict):
    """Remembers what ``make`` gave, and until the next ``turn`` what was there before the last one."""

    def __init__(self, make):
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text)
        if found is None:
            found = self.make(text)
        self[text] = found
        return found

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _mapped(df: DataFrame, fields: list[T.StructField], source: str, fn) -> DataFrame:
    """Append columns; ``fn`` gives one list per new field for a batch of ``source``."""
    schema = T.StructType([*df.schema.fields, *fields])
    kinds = [{"binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()] for f in fields]
    at = df.columns.index(source)

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                rows = batch.slice(start, TOGETHER)
                made = fn(rows.column(at).to_pylist())
                arrays = [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: the tokens of the whole text as packed little-endian 32-bit integers.

    Null and empty texts have no tokens.  Other columns pass through untouched; an output name
    that is taken already raises ``ValueError``.
    """
    _free(df, ids)
    return _mapped(
        df, [T.StructField(ids, T.BinaryType())], text, lambda col: [[tokenizer(path).encode(t) for t in col]]
    )


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``: what the token ids stand for.  Null ids give an empty text."""
    _free(df, text)
    return _mapped(
        df, [T.StructField(text, T.StringType())], ids, lambda col: [[tokenizer(path).decode(i) for i in col]]
    )


def encode_decode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows.

    Null and empty texts have no tokens and decode to the empty text.  Every row gives a row, repeated
    ones too; an empty table gives none.  Texts are encoded whole, however long.  Other columns, null
    or not, pass through; an output name that is taken already raises ``ValueError``.
    """
    _free(df, ids, decoded)

    def both(col):
        bpe = tokenizer(path)
        packed = [bpe.encode(t) for t in col]
        return [packed, [bpe.decode(p) for p in packed]]

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())]
    return _mapped(df, fields, text, both)


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already; name others for the output")


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded"):
    """Count and fingerprints of encoded rows, as columns."""
    return [
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded).cast("binary"), 256).alias("decoded_sha256"),
    ]
