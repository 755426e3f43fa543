"""Column expressions over whole texts, for the operators that use only DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
#: What parts alphanumeric words: every ASCII character but digits and letters.
MARKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and however deep in lambdas body refers to it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, between: str = BLANKS) -> Column:
    """The non-empty parts of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def low(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def upto(last: Column) -> Column:
    """1, 2, ... last; empty if last is less than 1."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def grams(hashes: Column, size: int) -> Column:
    """A hash for each run of `size` neighbours, in order. That of an array is that of its values, one after the other; few
    are taken without an array."""
    own = lambda i: [F.get(hashes, i + (j - 1)) for j in range(size)] if size <= 8 else [F.slice(hashes, i, size)]
    return F.transform(upto(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(F.lit(size), *own(i)))


def least_of(values: Column, size: int) -> Column:
    """The least of each run of `size` neighbours, in order, by runs of doubling length; empty if there is no such run."""

    def shorter(a: Column, by: int) -> Column:
        many = F.greatest(F.size(a) - by, F.lit(0))
        return F.zip_with(F.slice(a, 1, many), F.slice(a, by + 1, many), lambda x, y: F.least(x, y))

    def step(a: Column, held: int) -> Column:
        by = min(held, size - held)
        return let(shorter(a, by), lambda b: step(b, held + by)) if by else a

    return step(values, 1)


def covered(spans: Column) -> Column:
    """How many places lie in any of the spans: structs (start, len), in any order."""
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("total"))

    def add(a: Column, x: Column) -> Column:
        end = x["start"] + x["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["total"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).alias("total"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda a: a["total"])
