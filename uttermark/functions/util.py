"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable, so it is computed once per row.

    Without this an array expression used inside a higher-order function would be
    evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(numbers: Column, block: int = 128) -> Column:
    """Running sums of an array.  Appending copies what is there, so blocks are summed first
    and then offset by the blocks before them."""

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

        def add(acc: Column, x: Column) -> Column:
            return let(
                acc["sum"] + x,
                lambda t: F.struct(t.alias("sum"), F.concat(acc["all"], F.array(t)).alias("all")),
            )

        return F.aggregate(a, start, add)["all"]

    def shifted(inside: Column) -> Column:
        ends = sums(F.transform(inside, lambda b: F.element_at(b, -1)))
        before = F.concat(F.array(F.lit(0)), ends)
        return F.flatten(
            F.zip_with(
                inside,
                F.slice(before, F.lit(1), F.size(inside)),
                lambda b, o: F.transform(b, lambda x: x + o),
            )
        )

    n_blocks = F.floor((F.size(numbers) + (block - 1)) / block).cast("int")
    starts = F.filter(F.sequence(F.lit(0), n_blocks), lambda i: i < n_blocks)
    return let(
        numbers,
        lambda a: let(F.transform(starts, lambda i: sums(F.slice(a, i * block + 1, F.lit(block)))), shifted),
    )


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``scale * num / den`` as a double, 0.0 when the denominator is 0."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(F.lit(scale) * n / d)


def f_score(p: Column, r: Column) -> Column:
    return ratio(F.lit(2.0) * p * r, p + r)


def unnest(df: DataFrame, keep: list, array: Column, name: str) -> DataFrame:
    """One row per element of a computed array; null elements are left out.

    A plain ``explode`` makes the optimizer add a filter on the size of the array below
    it, which computes the array a second time.  The outer form does not.
    """
    out = df.select(*keep, F.explode_outer(array).alias(name))
    return out.where(F.col(name).isNotNull())
