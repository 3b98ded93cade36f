"""Column functions over text: tokens, normal forms, surface features."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns. ``\w`` of the source semantics is letters, numbers and underscore
# in every script; Java's own ``\w`` is ASCII only, so the classes are spelled out.
WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"
WORD_OR_MARK = WORD + r"|[^\p{L}\p{N}_\s\p{Z}]"
NON_SPACE = r"[^\p{Z}\s]"
SPACES = r"[\s\p{Z}]+"

# English contractions in the order they are applied.  "'t" comes
# before "n't", so "don't" becomes "don not".
CONTRACTIONS = (
    ("'s", " is"),
    ("'ve", " have"),
    ("'t", " not"),
    ("'re", " are"),
    ("'m", " am"),
    ("'ll", " will"),
    ("'d", " would"),
    ("n't", " not"),
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased words; one inner apostrophe stays inside the word."""
    return _all(F.lower(text), WORD)


def normalize(text: Column) -> Column:
    return F.array_join(word_tokens(text), " ")


def char_tokens(text: Column) -> Column:
    """Every non-space character, for scripts written without spaces."""
    return _all(text, NON_SPACE)


def punct_tokens(text: Column) -> Column:
    """Words in their own case, and each punctuation mark as a token."""
    return _all(text, WORD_OR_MARK)


def space_tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def rouge_tokens(text: Column) -> Column:
    """ROUGE's tokens: lower-cased runs of ASCII letters and digits."""
    return _all(F.lower(text), "[a-z0-9]+")


def bleu13a_tokens(text: Column) -> Column:
    """The mteval 13a tokeniser (fixed patterns, case kept)."""
    t = F.regexp_replace(text, r"[\s\p{Z}]+$", "")
    for old, new in (("<skipped>", ""), ("-\n", ""), ("\n", " ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return space_tokens(t)


def expand_contractions(text: Column, lang: Column) -> Column:
    """Lower-case, expand contractions for English only, drop dots after a word
    character and collapse white space."""
    low = F.lower(text)
    en = low
    for short, long in CONTRACTIONS:
        en = F.replace(en, F.lit(short), F.lit(long))
    t = F.when(lang == "en", en).otherwise(low)
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])\.", "$1")
    return F.trim(F.regexp_replace(t, SPACES, " "))


def _accent_map() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters whose decomposition is one base letter plus marks."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        bare = [c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)]
        if len(bare) == 1 and bare[0] != chr(cp):
            src.append(chr(cp))
            dst.append(bare[0])
    return "".join(src), "".join(dst)


_ACCENTED, _BARE = _accent_map()


def strip_accents(text: Column) -> Column:
    """Lower-case without accents for Latin, Greek and Cyrillic script, all inside the JVM."""
    bare = F.translate(F.regexp_replace(text, r"\p{Mn}", ""), _ACCENTED, _BARE)
    return F.lower(bare)


@F.pandas_udf(T.StringType())
def strip_accents_any(text: pd.Series) -> pd.Series:
    """As ``strip_accents`` for every script (full compatibility decomposition)."""

    def bare(s):
        if s is None:
            return None
        parts = unicodedata.normalize("NFKD", s)
        return "".join(c for c in parts if not unicodedata.combining(c)).lower()

    return text.map(bare)


def strip_suffix(tokens: Column) -> Column:
    """Each token up to its last apostrophe, if only letters and digits follow that."""
    return F.transform(tokens, lambda t: F.regexp_replace(t, r"'[\p{L}\p{N}_]*$", ""))


def canonicalize(text: Column) -> Column:
    """Lower-case, single spaces, no closing full stop, question or exclamation mark."""
    t = F.trim(F.regexp_replace(F.lower(text), SPACES, " "))
    return F.trim(F.regexp_replace(t, r"[.?!]+$", ""))


def strip_placeholders(text: Column) -> Column:
    """``<x>`` and ``{{x}}`` vanish, ``(x)`` keeps its inside."""
    t = F.regexp_replace(text, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"\{\{[^}]+\}\}", "")
    t = F.regexp_replace(t, r"\(([^)]+)\)", "$1")
    return F.regexp_replace(t, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def opener(text: Column) -> Column:
    """First white-space token of the lower-cased text, '' for an empty text."""
    return F.coalesce(F.get(space_tokens(F.lower(text)), F.lit(0)), F.lit(""))


def has_contraction(text: Column) -> Column:
    return text.rlike(r"'[\p{L}\p{N}_]")


def word_count(text: Column) -> Column:
    return F.size(space_tokens(text))


def is_short(text: Column, limit: int = 3) -> Column:
    return word_count(text) <= limit


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens joined by a space; empty when the text is shorter.

    Tokens hold no space, so the runs can be read off the joined text by overlapping
    matches, which is about twice as fast as slicing the array per position.
    """
    if n == 1:
        return tokens
    run = f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{n - 1}}}))"
    return F.regexp_extract_all(F.array_join(tokens, " "), F.lit(run), F.lit(1))
