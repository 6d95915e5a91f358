"""What a word is, for every operator of this subpackage.

A word is a run of characters other than space, tab, newline, vertical tab,
form feed and carriage return. ``bytes.split()`` without arguments splits at
exactly these six, so Python stages split encoded text; ``WORD`` and ``BLANKS``
are the same rule as Java regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_BYTES = b" \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: bytes.translate table that lower-cases A-Z only.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def encode(text: str | None) -> bytes:
    """UTF-8 bytes; null is the empty text, lone surrogates become '?'."""
    return text.encode("utf-8", "replace") if text else b""


def word_array(text: Column) -> Column:
    """The words of a text as an array, [] for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long, 0 for null."""
    return F.size(word_array(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sums of an array of ints that are not negative, each with its own number, or what else
    ``combine`` makes of them (it must take 0 as nothing).

    In rounds, each of which combines every element with the one twice as far before it as in the last: the
    work is n log n. (A list grown by ``aggregate`` is copied at every step.)
    """

    def scanned(values: Column) -> Column:
        def round_(so_far: Column, k: Column) -> Column:
            shift = F.pow(F.lit(2), k).cast("int")
            before = F.concat(F.array_repeat(F.lit(0), shift), F.slice(so_far, F.lit(1), F.size(so_far) - shift))
            return F.zip_with(so_far, before, lambda a, b: combine(a, b))

        return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), values, round_)).otherwise(values)

    return let(numbers, scanned)
