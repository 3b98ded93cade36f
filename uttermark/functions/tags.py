"""BIO tag algebra inside one row: no shuffle, linear in the number of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from uttermark.functions.text import strip_accents, word_tokens
from uttermark.functions.util import let

ANY = 2147483647  # "to the end" length for substring


def tag_type(tag: Column) -> Column:
    """Slot type of a B-/I- tag, null for anything else."""
    return F.when(tag.rlike("^[BI]-"), F.substring(tag, 3, ANY))


def split_tags(tags: Column) -> Column:
    """Space-joined tags to an array."""
    return F.filter(F.split(tags, r"\s+"), lambda t: t != "")


def begin_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.startswith("B-"))


def align_tags(tokens: Column, tags: Column) -> Column:
    """Pad with O or cut, so that there is one tag per token."""
    n = F.size(tokens)
    return F.slice(F.concat(tags, F.array_repeat(F.lit("O"), n)), F.lit(1), n)


def default_tags(tokens: Column, tags: Column) -> Column:
    """All-O tags where none were given."""
    filled = F.when(F.size(tags) > 0, tags)
    return F.coalesce(filled, F.array_repeat(F.lit("O"), F.size(tokens)))


def bio_error(tokens: Column, tags: Column) -> Column:
    """'' for valid tags; otherwise the first reason they are not."""

    def body(t):
        bad = F.filter(
            F.transform(
                t,
                lambda x, i: F.when(
                    x.startswith("I-") & ~tag_type(x).eqNullSafe(tag_type(F.get(t, i - 1))), x
                ),
            ),
            lambda x: x.isNotNull(),
        )
        first = F.get(bad, F.lit(0))
        return F.when(first.isNull(), "").otherwise(
            F.concat(F.lit("opens-inside:"), first)
        )

    mismatch = F.concat(F.lit("lengths:"), F.size(tokens), F.lit("/"), F.size(tags))
    return F.when(F.size(tokens) != F.size(tags), mismatch).otherwise(let(tags, body))


def runs(tags: Column, plain: bool = False) -> Column:
    """Maximal runs of one slot type as ``array<struct<start, end, label>>``.

    A run opens at a B- tag or where the type changes; the end is exclusive.  With
    ``plain`` the runs of untyped tags are kept too, with a null label.
    """

    def body(t):
        n = F.size(t)
        cut = F.filter(
            F.sequence(F.lit(0), n),
            lambda i: (i == 0)
            | (i == n)
            | F.coalesce(F.get(t, i).startswith("B-"), F.lit(False))
            | ~tag_type(F.get(t, i)).eqNullSafe(tag_type(F.get(t, i - 1))),
        )

        def between(c):
            k = F.size(c) - 1
            return F.zip_with(
                F.slice(c, F.lit(1), k),
                F.slice(c, F.lit(2), k),
                lambda s, e: F.struct(
                    s.alias("start"), e.alias("end"), tag_type(F.get(t, s)).alias("label")
                ),
            )

        return let(cut, between)

    found = let(tags, body)
    return found if plain else F.filter(found, lambda r: r["label"].isNotNull())


def spans(tags: Column) -> Column:
    """Typed spans of a tag sequence."""
    return runs(tags)


def span_values(tokens: Column, tags: Column, build) -> Column:
    """``build(tokens, span)`` of every span, with the tokens computed once."""
    return let(tokens, lambda k: F.transform(spans(tags), lambda s: build(k, s)))


def span_text(tokens: Column, span: Column) -> Column:
    return F.array_join(F.slice(tokens, span["start"] + 1, span["end"] - span["start"]), " ")


# ---- placing slot values on tokens -------------------------------------------------


def hit(start: Column, length: Column) -> Column:
    """``struct<start, len>``, null when there is no start."""
    return F.when(
        start.isNotNull(), F.struct(start.cast("int").alias("start"), length.alias("len"))
    )


def find_run(tokens: Column, value: Column, free_in: Column | None = None) -> Column:
    """First place where the token sequence ``value`` occurs in ``tokens``.

    With ``free_in`` (a tag array) places that already hold a tag are passed over.
    """
    k = F.size(value)

    def fits(i):
        same = F.slice(tokens, i + 1, k) == value
        if free_in is None:
            return same
        taken = F.exists(F.slice(free_in, i + 1, k), lambda x: x != "O")
        return F.when(same, ~taken).otherwise(False)

    last = F.size(tokens) - k
    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits)
    return F.when((k > 0) & (last >= 0), hit(F.get(places, F.lit(0)), k))


def find_containing(tokens: Column, value: Column) -> Column:
    """First single token that contains the first token of the value."""
    head = F.get(value, F.lit(0))
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda i: F.get(tokens, i).contains(head),
    )
    return F.when((F.size(value) > 0) & (F.size(tokens) > 0), hit(F.get(places, F.lit(0)), F.lit(1)))


def find_fused(tokens: Column, value: Column) -> Column:
    """First apostrophe-fused token one part of which is the single value token."""
    head = F.get(value, F.lit(0))
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda i: F.get(tokens, i).contains("'")
        & F.array_contains(F.split(F.get(tokens, i), "'"), head),
    )
    one = (F.size(value) == 1) & (F.size(tokens) > 0)
    return F.when(one, hit(F.get(places, F.lit(0)), F.lit(1)))


def put(tags: Column, place: Column, slot_type: Column) -> Column:
    """Write one slot over the tags; a place that is null or taken changes nothing."""
    start, length = place["start"], place["len"]
    free = place.isNotNull() & ~F.exists(F.slice(tags, start + 1, length), lambda x: x != "O")
    written = F.transform(
        tags,
        lambda x, i: F.when(i == start, F.concat(F.lit("B-"), slot_type))
        .when((i > start) & (i < start + length), F.concat(F.lit("I-"), slot_type))
        .otherwise(x),
    )
    return F.when(F.coalesce(free, F.lit(False)), written).otherwise(tags)


def blank_tags(tokens: Column) -> Column:
    return F.array_repeat(F.lit("O"), F.size(tokens))


def fold_slots(tokens: Column, slots: Column, step) -> Column:
    """Apply ``step(tags, tokens, slot) -> tags`` slot by slot, in order."""
    return let(
        tokens, lambda t: F.aggregate(slots, blank_tags(t), lambda acc, s: step(acc, t, s))
    )


def usable(slot_type: Column, value: Column) -> Column:
    return (F.coalesce(slot_type, F.lit("")) != "") & (F.coalesce(value, F.lit("")) != "")


def place_slots(tokens: Column, slots: Column, on_overlap: str = "next") -> Column:
    """Greedy placement of ``array<struct<slot_type, value>>`` in the order given.

    ``on_overlap='next'`` looks for a later free occurrence, ``'skip'`` gives the
    slot up when its first occurrence is taken.
    """

    def step(acc, t, s):
        def with_value(v):
            place = find_run(t, v, acc if on_overlap == "next" else None)
            return let(place, lambda p: put(acc, p, s["slot_type"]))

        ok = usable(s["slot_type"], s["value"])
        return F.when(ok, let(word_tokens(s["value"]), with_value)).otherwise(acc)

    return fold_slots(F.transform(tokens, F.lower), slots, step)


def folded(tokens: Column) -> Column:
    return F.transform(tokens, strip_accents)
