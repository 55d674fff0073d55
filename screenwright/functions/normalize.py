"""Text normalisation as column expressions.

Unicode composition (NFKC) is the one step Spark has no expression for; see
``operators.normalize``. All functions here expect composed text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.functions.core import let, strip

# The characters taken out of a text.
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ZERO_WIDTH_CHARS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
# Both of the above plus carriage return: one look tells if any step applies.
UNWANTED_CHARS = r"[\x00-\x08\x0B-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
LONG_RUN = r"(?s)(.)\1{20,}"
RUN_LENGTH = 20


def remove_control_chars(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def remove_zero_width_chars(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH_CHARS, "")


def normalize_line_endings(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    """Squeeze spaces and strip every line, then keep at most one blank line in a row."""
    wide = F.contains(text, F.lit("  ")) | F.contains(text, F.lit("\t"))
    squeezed = F.when(wide, F.regexp_replace(text, "[ \t]+", " ")).otherwise(text)
    lines = F.array_join(F.transform(F.split(squeezed, "\n", -1), strip), "\n")
    return let(
        lines,
        lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t),
    )


def collapse_long_runs(text: Column, max_repeats: int = RUN_LENGTH) -> Column:
    """Cut runs of 21 or more of one character to ``max_repeats``."""
    if max_repeats < 1:
        raise ValueError("max_repeats must be at least 1.")
    return F.regexp_replace(text, LONG_RUN, "$1" * max_repeats)


def normalized(composed: Column, original_length: Column, collapse_runs: bool = True) -> Column:
    """Struct of the normalised text and what was done to it."""

    def removed(text: Column) -> Column:
        def counted(without_control: Column) -> Column:
            return let(
                remove_zero_width_chars(without_control),
                lambda clean: F.struct(
                    normalize_line_endings(clean).alias("text"),
                    (F.length(text) - F.length(without_control)).alias("control"),
                    (F.length(without_control) - F.length(clean)).alias("zero_width"),
                ),
            )

        untouched = F.struct(text.alias("text"), F.lit(0).alias("control"), F.lit(0).alias("zero_width"))
        return F.when(text.rlike(UNWANTED_CHARS), let(remove_control_chars(text), counted)).otherwise(untouched)

    def finished(step: Column) -> Column:
        spaced = normalize_whitespace(step["text"])
        final = strip(collapse_long_runs(spaced) if collapse_runs else spaced)
        return let(
            final,
            lambda t: F.struct(
                t.alias("text"),
                original_length.alias("original_length"),
                F.length(t).alias("normalized_length"),
                step["control"].alias("removed_control_chars"),
                step["zero_width"].alias("removed_zero_width_chars"),
                (original_length != F.length(t)).alias("changed"),
            ),
        )

    return F.when(composed.isNotNull(), let(let(composed, removed), finished))


def normalized_text(composed: Column, collapse_runs: bool = True) -> Column:
    return normalized(composed, F.lit(0), collapse_runs)["text"]
