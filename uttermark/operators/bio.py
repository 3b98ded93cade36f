"""Slot values, BIO tags, spans and chunks of annotated utterances.

Each utterance is one row and every operator works inside the row, so none of them
shuffles.  Slots are ``array<struct<slot_type, value>>``, translations
``array<struct<slot_type, original, translated>>`` and chunks
``array<struct<text, slot_name>>`` with a null slot_name for plain text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttermark.functions import tags as B
from uttermark.functions.text import (
    char_tokens,
    expand_contractions,
    punct_tokens,
    space_tokens,
    strip_suffix,
    word_tokens,
)
from uttermark.functions.util import let, unnest


def bio_spans(df: DataFrame, key: list[str], tags: str) -> DataFrame:
    """One row per span: key, ``start``, ``end`` (exclusive), ``label``."""
    return unnest(df, key, B.spans(F.col(tags)), "_s").select(*key, "_s.*")


def slots_to_bio(df: DataFrame, tokens: str, slots: str, on_overlap: str = "next") -> DataFrame:
    """Add ``bio``: predicted slot values placed greedily on the tokens, in their order."""
    return df.withColumn("bio", B.place_slots(F.col(tokens), F.col(slots), on_overlap))


def source_bio(df: DataFrame, text: str, slots: str) -> DataFrame:
    """Add ``tokens`` (lower-cased, by white space) and ``bio``: the first occurrence of
    each slot, applied from left to right; an overlapping one is left out."""

    def places(t: Column) -> Column:
        found = F.transform(
            F.col(slots),
            lambda s, i: let(
                B.find_run(t, space_tokens(F.lower(s["value"]))),
                lambda p: F.when(
                    p.isNotNull(),
                    F.struct(
                        p["start"].alias("start"),
                        i.alias("no"),
                        p["len"].alias("len"),
                        s["slot_type"].alias("slot_type"),
                    ),
                ),
            ),
        )
        return F.array_sort(F.filter(found, lambda p: p.isNotNull()))

    out = df.withColumn("tokens", space_tokens(F.lower(F.col(text))))
    bio = let(
        F.col("tokens"),
        lambda t: F.aggregate(
            places(t),
            B.blank_tags(t),
            lambda acc, p: B.put(acc, p, p["slot_type"]),
        ),
    )
    return out.withColumn("bio", bio)


def _translated(slot: Column, translations: Column) -> Column:
    """Translation of the slot's value; of several entries the last; else the value."""
    key = F.lower(F.trim(slot["value"]))
    hits = F.filter(
        translations,
        lambda x: (F.lower(F.trim(x["original"])) == key)
        & (F.trim(F.coalesce(x["translated"], F.lit(""))) != ""),
    )
    last = F.try_element_at(hits, F.lit(-1))
    return F.coalesce(F.trim(last["translated"]), slot["value"])


def _project(tokens: Column, slots: Column, translations: Column, find) -> Column:
    """Place each source slot by its translated value, else by its source value; a place
    that is taken gives the slot up."""

    def step(acc: Column, t: Column, s: Column, tr: Column) -> Column:
        def place(v: Column) -> Column:
            own = F.when(v != s["value"], find(t, s["value"]))
            return let(F.coalesce(find(t, v), own), lambda p: B.put(acc, p, s["slot_type"]))

        ok = B.usable(s["slot_type"], s["value"])
        return F.when(ok, let(_translated(s, tr), place)).otherwise(acc)

    def fold(t: Column, tr: Column) -> Column:
        return F.aggregate(slots, B.blank_tags(t), lambda acc, s: step(acc, t, s, tr))

    return let(tokens, lambda t: let(translations, lambda tr: fold(t, tr)))


def _caseless(tokens: Column, value: Column, free_in: Column | None = None) -> Column:
    def find(t: Column) -> Column:
        return let(F.transform(value, F.lower), lambda v: B.find_run(t, v, free_in))

    return let(F.transform(tokens, F.lower), find)


def _named(value: Column, place) -> Column:
    """No place for an empty value or the word none."""
    return F.when((value != "") & (F.lower(value) != "none"), place)


def project_slots(
    df: DataFrame, text: str, slots: str, translations: str, is_char: Column, substring: bool = True
) -> DataFrame:
    """Project source slots onto a translation; add ``tokens`` and ``bio``.

    Words: the token sequence, then (``substring``) a token that contains the value's
    first word.  Characters: the exact sequence, then without regard to case.
    """

    def by_word(t: Column, value: Column) -> Column:
        def find(v: Column) -> Column:
            exact = B.find_run(t, v)
            return F.coalesce(exact, B.find_containing(t, v)) if substring else exact

        return _named(value, let(word_tokens(value), find))

    def by_char(t: Column, value: Column) -> Column:
        def find(v: Column) -> Column:
            return F.coalesce(B.find_run(t, v), _caseless(t, v))

        return _named(value, let(char_tokens(value), find))

    t = F.col(text)
    out = df.withColumn("tokens", F.when(is_char, char_tokens(t)).otherwise(word_tokens(t)))
    args = (F.col("tokens"), F.col(slots), F.col(translations))
    bio = F.when(is_char, _project(*args, by_char)).otherwise(_project(*args, by_word))
    return out.withColumn("bio", bio)


def project_slots_folded(
    df: DataFrame, text: str, slots: str, translations: str, reversed_order: bool = False
) -> DataFrame:
    """As ``project_slots`` without accents: sequence, then a part of an apostrophe-fused
    token.  A hyphen separates words already.  ``reversed_order`` also tries the words of a
    hyphenated value backwards; the source semantics never get that far."""

    def find(t: Column, value: Column) -> Column:
        def among(folded_tokens: Column) -> Column:
            def place(v: Column) -> Column:
                steps = [B.find_run(folded_tokens, v), B.find_fused(folded_tokens, v)]
                if reversed_order:
                    steps.append(
                        F.when(value.contains("-"), B.find_run(folded_tokens, F.reverse(v)))
                    )
                return F.coalesce(*steps)

            return let(B.folded(word_tokens(value)), place)

        return _named(value, let(B.folded(t), among))

    out = df.withColumn("tokens", word_tokens(F.col(text)))
    args = (F.col("tokens"), F.col(slots), F.col(translations))
    return out.withColumn("bio", _project(*args, find))


def reproject(
    df: DataFrame, text: str, translations: str, lang: str, is_char: Column
) -> DataFrame:
    """Project again on the tokens that are written out; add ``tokens`` and ``bio``.

    White-space tokens of the normalised text, first as they are and then without
    apostrophe suffixes; characters for scripts without spaces.  A place that is taken
    moves the search on to the next occurrence.
    """
    code = F.col(lang)

    def words(acc: Column, t: Column, s: Column) -> Column:
        def place(v: Column) -> Column:
            bare = let(
                strip_suffix(t), lambda b: let(strip_suffix(v), lambda w: B.find_run(b, w, acc))
            )
            best = F.coalesce(B.find_run(t, v, acc), bare)
            return let(best, lambda p: B.put(acc, p, s["slot_type"]))

        ok = B.usable(s["slot_type"], s["translated"])
        value = space_tokens(expand_contractions(s["translated"], code))
        return F.when(ok, let(value, place)).otherwise(acc)

    def chars(acc: Column, t: Column, s: Column) -> Column:
        def place(v: Column) -> Column:
            low = _caseless(t, v, acc)
            best = F.coalesce(B.find_run(t, v, acc), low)
            return let(best, lambda p: B.put(acc, p, s["slot_type"]))

        ok = B.usable(s["slot_type"], s["translated"])
        return F.when(ok, let(char_tokens(s["translated"]), place)).otherwise(acc)

    t = F.col(text)
    tokens = F.when(is_char, char_tokens(t)).otherwise(space_tokens(expand_contractions(t, code)))
    out = df.withColumn("tokens", tokens)
    bio = F.when(is_char, B.fold_slots(F.col("tokens"), F.col(translations), chars)).otherwise(
        B.fold_slots(F.col("tokens"), F.col(translations), words)
    )
    return out.withColumn("bio", bio)


def keep_source_tags(df: DataFrame, lang: str, source: str, projected: str, code: str = "en"):
    """Add ``bio``: the source tags for the source language where given, else the projected."""
    own = (F.col(lang) == code) & (F.coalesce(F.size(source), F.lit(0)) > 0)
    return df.withColumn("bio", F.when(own, F.col(source)).otherwise(F.col(projected)))


# ---- chunks ---------------------------------------------------------------------------


def chunks_to_bio(df: DataFrame, chunks: str) -> DataFrame:
    """Add ``tokens``, ``bio`` and ``text``: B- and I- over the tokens of each slot chunk."""
    per = F.transform(
        F.col(chunks),
        lambda c: F.struct(punct_tokens(c["text"]).alias("toks"), c["slot_name"].alias("slot")),
    )

    def tag(c: Column) -> Column:
        return F.transform(
            c["toks"],
            lambda t, i: F.when(c["slot"].isNull(), "O").otherwise(
                F.concat(F.when(i == 0, "B-").otherwise("I-"), c["slot"])
            ),
        )

    out = df.withColumn("_per", per)
    text = F.trim(F.array_join(F.transform(F.col(chunks), lambda c: c["text"]), ""))
    return (
        out.withColumn("tokens", F.flatten(F.transform("_per", lambda c: c["toks"])))
        .withColumn("bio", F.flatten(F.transform("_per", tag)))
        .withColumn("text", text)
        .drop("_per")
    )


def _cut_chunks(words: Column, tags: Column) -> Column:
    """A chunk starts at a B- tag and where O follows a slot.  An I- tag with no slot
    before it takes the plain words before it into its slot."""

    def body(tokens: Column, t: Column) -> Column:
        n = F.size(t)
        cuts = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: (i == 0)
            | (i == n)
            | F.coalesce(F.get(t, i).startswith("B-"), F.lit(False))
            | ((F.get(t, i) == "O") & (F.get(t, i - 1) != "O")),
        )

        def between(c: Column) -> Column:
            k = F.size(c) - 1

            def chunk(s: Column, e: Column) -> Column:
                typed = F.filter(F.slice(t, s + 1, e - s), lambda x: x != "O")
                slot = B.tag_type(F.get(typed, F.lit(0)))
                span = F.array_join(F.slice(tokens, s + 1, e - s), " ")
                before = F.when(s > 0, " ").otherwise("")
                after = F.when(e < n, " ").otherwise("")
                text = F.when(slot.isNull(), F.concat(before, span, after)).otherwise(span)
                return F.struct(text.alias("text"), slot.alias("slot_name"))

            return F.zip_with(F.slice(c, F.lit(1), k), F.slice(c, F.lit(2), k), chunk)

        return F.when(n > 0, let(cuts, between)).otherwise(
            F.array().cast("array<struct<text:string,slot_name:string>>")
        )

    return let(words, lambda tokens: let(tags, lambda t: body(tokens, t)))


def bio_to_chunks(df: DataFrame, tokens: str, tags: str) -> DataFrame:
    """Add ``chunks``; plain chunks own the spaces around slot chunks."""
    aligned = B.align_tags(F.col(tokens), F.col(tags))
    return df.withColumn("chunks", _cut_chunks(F.col(tokens), aligned))


def merge_text_chunks(chunks: Column) -> Column:
    """Adjacent plain chunks become one."""

    def body(c: Column) -> Column:
        n = F.size(c)
        cuts = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: (i == 0)
            | (i == n)
            | F.get(c, i)["slot_name"].isNotNull()
            | F.get(c, i - 1)["slot_name"].isNotNull(),
        )

        def between(k: Column) -> Column:
            m = F.size(k) - 1
            return F.zip_with(
                F.slice(k, F.lit(1), m),
                F.slice(k, F.lit(2), m),
                lambda s, e: F.struct(
                    F.array_join(
                        F.transform(F.slice(c, s + 1, e - s), lambda x: x["text"]), ""
                    ).alias("text"),
                    F.get(c, s)["slot_name"].alias("slot_name"),
                ),
            )

        return let(cuts, between)

    return let(chunks, body)


def demote_slot(df: DataFrame, chunks: str, slot: str, value: str) -> DataFrame:
    """Repair a mislabel: where the first chunk of ``slot`` holds ``value`` (such as the
    slot's own name), its chunks become plain text.  Adds ``demoted``."""
    c = F.col(chunks)
    first = F.get(F.filter(c, lambda x: x["slot_name"] == slot), F.lit(0))["text"]
    hit = F.coalesce(F.lower(F.trim(first)) == value, F.lit(False))
    plain = F.transform(
        c,
        lambda x: F.struct(
            x["text"].alias("text"),
            F.when(x["slot_name"].eqNullSafe(F.lit(slot)), None).otherwise(x["slot_name"]).alias("slot_name"),
        ),
    )
    out = df.withColumn("demoted", hit)
    return out.withColumn(chunks, F.when(F.col("demoted"), merge_text_chunks(plain)).otherwise(c))
