"""Token counts of a piece vocabulary, by merging without writing any tokens.

A text is a list of letters; the neighbours whose joined text is the best-scored piece merge
first.  A heap hands out the best pair, a doubly linked list keeps who is next to whom, and the
count is the number of letters less the number of merges.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Stretches whose count is remembered by one worker; the memory is emptied when full.
REMEMBERED = 600_000
BLANK = "▁"  # what a vocabulary of pieces writes for a space


class PieceCounter:
    """Counts of a byte-fallback piece vocabulary, read from a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [
            i
            for i in range(model.vocab_size())
            if not (model.IsUnknown(i) or model.IsControl(i) or model.IsByte(i) or model.IsUnused(i))
        ]
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        if any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("pieces that span words are not supported")
        self.letters = {p for p in self.rank if len(p) == 1}
        # A letter that no longer piece holds stands alone; texts are cut there too.
        inside = set("".join(p for p in self.rank if len(p) > 1))
        self.breaks_at_newline = "\n" not in inside
        self.stretch = re.compile(f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n" if self.breaks_at_newline else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.newline = self.merged("\n")
        self.known: dict[str, int] = _Counts(self)

    def count(self, text: str | None) -> int:
        """Tokens of a text; null and empty texts have none."""
        if not text:
            return 0
        # Merges never reach over the start of a run of blanks, as no piece does.
        known, total = self.known, 0
        for line_no, line in enumerate(text.split("\n") if self.breaks_at_newline else [text]):
            lead = BLANK if line_no == 0 else ""
            if line_no:
                total += self.newline
            words = line.split(" ")
            if BLANK in line or "" in words:
                total += sum([known[s] for s in self.stretch.findall(lead + line.replace(" ", BLANK))])
                continue
            if lead:
                total += sum([known[BLANK + w] for w in words])
            else:
                total += known[words[0]] + sum([known[BLANK + w] for w in words[1:]])
        if len(known) > REMEMBERED:
            known.clear()
        return total

    def merged(self, text: str) -> int:
        """Letters less merges; a letter that is no piece counts its bytes."""
        n, rank = len(text), self.rank
        before = list(range(-1, n - 1))
        after = list(range(1, n + 1))
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(text[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, left, to = heappop(heap)
            right = after[left] if end[left] else n
            if right >= n or not end[left] or end[right] != to:
                continue  # one of the two has changed since
            merges += 1
            end[left], end[right] = to, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                further = end[after[left]]
                if (r := rank.get(text[left:further])) is not None:
                    heappush(heap, (r, left, further))
            if (prev := before[left]) >= 0 and (r := rank.get(text[prev:to])) is not None:
                heappush(heap, (r, prev, to))
        letters = self.letters
        extra = sum([len(c.encode()) - 1 for c in text if c not in letters])
        return n + extra - merges


class _Counts(dict):
    def __init__(self, counter: PieceCounter):
        self.counter = counter

    def __missing__(self, text: str) -> int:
        found = self[text] = self.counter.merged(text)
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Append ``out``: the number of tokens of the whole text; 0 for null and empty texts.

    Every row gives a row, repeated ones too; an empty table gives none.  Texts are counted whole,
    however long.  Other columns, null or not, pass through; an output name that is taken raises
    ``ValueError``.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {out} already; name another for the output")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])
    at = df.columns.index(text)

    def run(batches):
        tokens = counter(path)
        for batch in batches:
            made = pa.array([tokens.count(t) for t in batch.column(at).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)
