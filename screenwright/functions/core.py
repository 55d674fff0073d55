"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.constants import WHITESPACE

# Regex classes that agree with Python's Unicode \s and \w.
SPACE = (
    r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WORD = r"[\p{L}\p{N}_]"

# Code points per page when a text is cut up for random access.
PAGE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst does not share subexpressions inside lambdas; a one-element
    ``transform`` binds the value to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """``str.strip()``."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    """``str.rstrip()``."""
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def paged(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column], page: int = PAGE) -> Column:
    """Give ``body`` a ``slice(start, end)`` over ``text`` (0-based, half open).

    ``substring`` counts code points from the start of a string each time, so
    many slices of a long text cost its length squared. Cutting the text into
    pages first keeps every slice to the pages it touches.
    """
    pages = F.when(F.length(text) <= page, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % page), F.lit(0))
    )

    def with_pages(cut: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / page).cast("int")
            count = F.floor((end - 1) / page).cast("int") - first + 1
            return F.when(end <= start, F.lit("")).otherwise(
                F.substring(F.array_join(F.slice(cut, first + 1, count), ""), start - first * page + 1, end - start)
            )

        return body(part)

    return let(pages, with_pages)


def note(notes: Column, *numbers: Column) -> Column:
    """Append numbers to the notes of a fold.

    Arrays that grow inside a fold are copied element by element at every step;
    a string of numbers is cheap to extend. ``noted`` turns it into an array.
    """
    return F.concat(notes, *(part for number in numbers for part in (number.cast("string"), F.lit(","))), F.lit(";"))


def noted(notes: Column, *names: str) -> Column:
    """Array of structs of the noted numbers, one per ``note``."""

    def entry(text: Column) -> Column:
        numbers = F.split(text, ",")
        return F.struct(*(F.element_at(numbers, at).cast("int").alias(name) for at, name in enumerate(names, start=1)))

    return F.transform(F.filter(F.split(notes, ";"), lambda text: text != ""), entry)


def clamp(score: Column) -> Column:
    """Keep a score inside 0..1; NaN becomes 1.0 and null stays null."""
    value = score.cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def two_decimals(score: Column) -> Column:
    """Text of a 0..1 score with two decimals, rounded on its exact binary value.

    Printing functions of the JVM round the shortest decimal form half up,
    which differs at midpoints such as 0.845. A double at or above 2**-8 is a
    whole number of 2**-61 steps, so decimal integer arithmetic is exact.
    """
    steps = 2.0**61
    unit = F.lit(int(steps)).cast("decimal(20,0)")
    half = F.lit(int(steps) // 2).cast("decimal(20,0)")

    def rounded(scaled: Column) -> Column:
        whole = F.floor(scaled / unit).cast("int")
        rest = scaled - whole.cast("decimal(20,0)") * unit
        up = (rest > half) | ((rest == half) & (whole % 2 == 1))
        return whole + F.when(up, 1).otherwise(0)

    cents = let((score * F.lit(steps)).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(4,0)"), rounded)
    exact = let(
        cents,
        lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")),
    )
    return F.when(score.between(0.0, 1.0), exact).when(score.isNotNull(), F.format_string("%.2f", score))
