"""Work on a row's own array without leaving the row: no shuffle, and each part is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def places(items: Column) -> Column:
    """0, 1, ... for each item."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def running_totals(numbers: Column, step: int = 256) -> Column:
    """The sum of the numbers up to and with each; in two levels, so a long array is not copied number by number."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x)

    def two(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, total), zero, add)
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: let(F.aggregate(p, F.array(F.get(b, k)), add), lambda t: F.slice(t, F.lit(2), F.size(t))))))

    count = F.ceil(F.size(numbers) / step).cast("int")
    parts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(numbers, k * step + 1, step))).otherwise(F.array().cast("array<array<bigint>>"))
    return let(parts, two)


def counted(words: Column) -> Column:
    """``n, word`` of each distinct word, the most frequent first, equals by alphabet."""

    def runs(w: Column) -> Column:
        starts = F.filter(places(w), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        sized = lambda s: F.transform(s, lambda i, k: F.struct((i - F.coalesce(F.get(s, k + 1), F.size(w))).cast("long").alias("minus"), F.get(w, i).alias("word")))
        return let(starts, sized)

    ranked = F.array_sort(let(F.array_sort(words), runs))
    return F.transform(ranked, lambda r: F.struct((-r["minus"]).alias("n"), r["word"].alias("word")))
