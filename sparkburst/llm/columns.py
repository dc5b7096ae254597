"""Column helpers for operators that stay within Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def running_sum(values: Column, block: int = 256) -> Column:
    """Inclusive cumulative sums of an array<long>, in blocks so that long arrays stay cheap."""
    none = F.array().cast("array<long>")

    def summed(xs: Column) -> Column:
        return F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x)))

    def joined(parts: Column) -> Column:
        ends = summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0).cast("long"))))))

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: summed(F.slice(xs, b * block + 1, F.lit(block))))

    return let(values, lambda xs: F.when(F.size(xs) == 0, none).otherwise(let(blocks(xs), joined)))
