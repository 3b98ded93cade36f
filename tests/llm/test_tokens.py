"""Encoding, decoding and counting against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, empty
from uttermark.llm import bpe, minhash, piece_counts
from uttermark.llm.queries import PIECES, WORD_BPE

PARTS = [
    "a", "b", "The", "ing", "'s", "'S", "É", "Σ", "İ", "ß", " ", "  ", "\n", "\t", "1", "23", "!", "...", "aaaa", "中文",
    "́", "\x85", "\x1c", "🙂", "</w>", "<|endoftext|>", "<|startoftext|>", "▁", "<s>", "<0x0A>", "ﬁ", "ࡰ", "\x00",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 20))) for _ in range(3000)]
    return [*made, "a" * 20_000, "thethe" * 3000, "x y " * 5000]


def test_encoding_and_decoding_are_the_librarys(texts):
    path = public_tokenizers.path(WORD_BPE)
    ours, theirs = bpe.tokenizer(path), Tokenizer.from_file(path)
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == ids
        assert ours.decode(ours.encode(t)) == theirs.decode(ids, skip_special_tokens=False)


def test_pairs_fit_when_their_text_encodes_to_them():
    b = bpe.tokenizer(public_tokenizers.path(WORD_BPE))
    r = random.Random(2)
    body = [i for s, i in b.id_of.items() if ord(s[-1]) < 256]
    names = {i: s for s, i in b.id_of.items()}
    for _ in range(2000):
        pair = [r.choice(body), r.choice(list(names))]
        s = "".join(names[i] for i in pair)
        if ord(s[-1]) < 256:
            continue
        data = bytes(ord(c) % 256 for c in s)
        assert b.fits(*pair) == (merged_naively(b, s) == pair), data


def merged_naively(b, s):
    out = [b.id_of[c] for c in s]
    while True:
        ranks = [(b.merge[p], i) for i, p in enumerate(zip(out, out[1:])) if p in b.merge]
        if not ranks:
            return out
        rank, i = min(ranks)
        joined = next(t for t, (r, *_) in b.halves.items() if r == rank)
        out[i : i + 2] = [joined]


def test_counts_are_the_librarys(texts):
    path = public_tokenizers.path(PIECES)
    ours, theirs = piece_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for t in texts:
        assert ours.count(t) == len(theirs.encode(t))


def test_awkward_rows(spark):
    path = public_tokenizers.path(WORD_BPE)
    d = awkward(spark).drop("ids", "decoded", "n_tokens")
    rows = bpe.encode_decode(d, path).collect()
    assert len(rows) == d.count()
    for r in rows:
        if not (r["text"] or "").strip():
            assert r["ids"] == b"" and r["decoded"] == ""
    again = bpe.decode(bpe.encode(d, path), path).collect()
    assert [(r["doc_id"], r["decoded"]) for r in again] == [(r["doc_id"], r["decoded"]) for r in rows]
    with pytest.raises(ValueError):
        bpe.encode(awkward(spark), path)
    with pytest.raises(ValueError):
        piece_counts.count_tokens(awkward(spark), public_tokenizers.path(PIECES))
    assert bpe.encode_decode(empty(spark), path).count() == 0
    assert piece_counts.count_tokens(d, public_tokenizers.path(PIECES)).where("text IS NULL").first()["n_tokens"] == 0


def test_digests(spark):
    path = public_tokenizers.path(WORD_BPE)
    d = spark.createDataFrame([(1, "Hello, world")], "doc_id long, text string")
    e = bpe.encode_decode(d, path)
    r = e.select(*bpe.digests(e)).first()
    ids = Tokenizer.from_file(path).encode("Hello, world", add_special_tokens=False).ids
    assert r["n_tokens"] == len(ids)
    assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_what_a_process_remembers_between_tasks_is_bounded():
    """Python processes are kept from stage to stage, and so is what they remember."""
    coder = bpe.tokenizer(public_tokenizers.path(WORD_BPE))
    for i in range(0, 160_000, 1000):
        coder.encode(" ".join(f"w{i + k}" for k in range(1000)))
        minhash.shingle_set(" ".join(f"w{i + k}" for k in range(1000)))
    assert max(map(len, (coder.known, coder.chunks, minhash._hashes))) <= 102_000


def test_words_in_use_are_remembered_when_the_memory_is_full():
    coder = bpe.WordBpe(public_tokenizers.path(WORD_BPE))
    cut, seen = coder.encode_word, []
    coder.encode_word = lambda data: seen.append(data) or cut(data)
    for i in range(0, 250_000, 1000):
        coder.encode("Usedagain, usedagain " + " ".join(f"w{i + k}" for k in range(1000)))
        assert len(coder.known) + len(coder.known.before) <= 2 * 102_000
    assert seen.count(b"usedagain") == 1
