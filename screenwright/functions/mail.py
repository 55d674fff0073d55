"""Body text of e-mail messages by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.functions.core import SPACE, let

# Lines taken out of a message body.
HEADER_LINE = r"(?iu)^(from|to|cc|bcc|subject|date|reply-to|message-id):"
REPLY_LINE = rf"(?iu)^{SPACE}*(>|on .+ wrote:|from:{SPACE}|sent:{SPACE}|subject:{SPACE})"

_EOL = r"(?:\r\n|\r|\n)"
_HEADER = rf"(?:[!-9;-~]*:|[\t ]|From )[^\r\n]*(?:{_EOL}|\z)"
HEADER_BLOCK = rf"\A(?:{_HEADER})*+"
# What str.splitlines() takes as the end of a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def header_block(raw: Column) -> Column:
    return F.regexp_extract(raw, HEADER_BLOCK, 0)


def may_be_multipart(raw: Column) -> Column:
    """True for every message that might have parts; these need a MIME parser."""
    return header_block(raw).rlike("(?i)(?:multipart|message)/")


def single_part_body(raw: Column) -> Column:
    """What follows the header block and its blank line.

    An envelope line that ends the header block belongs to the body.
    """

    def body(head: Column) -> Column:
        rest = F.regexp_replace(F.substring(raw, F.length(head) + 1, F.length(raw)), rf"\A{_EOL}", "")
        return F.concat(F.regexp_extract(head, rf"{_EOL}(From [^\r\n]*{_EOL}?)\z", 1), rest)

    return let(header_block(raw), body)


def split_lines(text: Column) -> Column:
    """``str.splitlines()``."""
    return let(
        F.split(text, LINE_END, -1),
        lambda lines: F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines),
    )


def _without(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(split_lines(text), lambda line: ~line.rlike(pattern)), "\n")


def remove_header_lines(text: Column) -> Column:
    """Drop all lines that look like message headers, in the body too."""
    return _without(text, HEADER_LINE)


def remove_reply_lines(text: Column) -> Column:
    """Drop quoted lines and the lines that introduce a quotation."""
    return _without(text, REPLY_LINE)
