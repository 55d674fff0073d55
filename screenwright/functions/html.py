"""Readable text and title of HTML pages by column expressions.

This is no HTML parser. Elements without text are left out with all they hold: scripts and
styles up to their first end tag, the others up to the end tag that belongs to them, however they nest.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.functions.core import let, strip

# Elements whose content is no text.
DROPPED_ELEMENTS = "script|style|noscript|template|svg|canvas"

# Of these, the ones whose content is markup again, so that they can nest.
NESTING_ELEMENTS = "noscript|template|svg|canvas"

# Inside a tag, quotes only count after "=". Every alternative may run into the
# end of the text, so one unclosed bracket cannot make matching start over.
_IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_COMMENT = r"<!--.*?(?:-->|\z)"
_DROPPED = rf"<({DROPPED_ELEMENTS})\b{_IN_TAG}(?:>|\z).*?(?:</\1\s*>|\z)"
_TAG = rf"<[a-z/!?]{_IN_TAG}(?:>|\z)"
MARKUP = rf"(?is){_COMMENT}|{_DROPPED}|{_TAG}"
NO_TEXT = rf"(?is){_COMMENT}|{_DROPPED}"
TITLE = rf"(?is)<title\b{_IN_TAG}>(.*?)</title\s*>"
_NESTING = rf"(?is)</?({NESTING_ELEMENTS})(?=[\s/>])"
_RAW = rf"<(script|style)\b{_IN_TAG}(?:>|\z).*?(?:</\1\s*>|\z)"
_NO_TAG = rf"(?is)\A(?:<!--|<(?:script|style)\b)"
TOKEN = rf"(?is){_COMMENT}|{_RAW}|{_TAG}"
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"


def _character(point: Column) -> Column:
    """The character of a code point; nothing for numbers that are none."""
    valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    as_bytes = F.unhex(F.lpad(F.hex(point), 8, "0"))
    return F.when(valid, F.decode(as_bytes, "UTF-32")).otherwise(F.lit(""))


def _entity(name: Column) -> Column:
    known = F.create_map(
        *(F.lit(part) for key, point in {**name2codepoint, "apos": 39}.items() for part in (key, chr(point)))
    )
    digits = F.regexp_extract(name, "[0-9a-fA-F]+", 0)
    hexadecimal = F.regexp_extract(name, "^&#[xX]([0-9a-fA-F]+)", 1)
    # No code point has more than 7 digits; leading zeros do not count.
    short = F.length(F.ltrim(digits, F.lit("0"))) <= 7
    hex_short = F.length(F.ltrim(hexadecimal, F.lit("0"))) <= 7
    return (
        F.when(
            hexadecimal != "",
            F.when(hex_short, _character(F.conv(hexadecimal, 16, 10).cast("bigint"))).otherwise(F.lit("")),
        )
        .when(
            F.startswith(name, F.lit("&#")),
            F.when(short, _character(F.conv(digits, 10, 10).cast("bigint"))).otherwise(F.lit("")),
        )
        .otherwise(F.coalesce(F.try_element_at(known, F.regexp_replace(name, "[&;]", "")), name))
    )


def decode_entities(text: Column) -> Column:
    """Replace named and numeric character references once."""
    names = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    decoded = F.zip_with(
        F.split(text, ENTITY, -1), names, lambda gap, name: F.concat(gap, F.when(name.isNull(), "").otherwise(_entity(name)))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def _outside_nesting(html: Column) -> Column:
    """``(tag, gap)`` for each piece of text outside nesting elements, with the token in front of it.

    One pass over the tokens: the outermost open element is known with the number of its own
    name open inside it, and only its own end tags count, so elements left open inside it end with it.
    """
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))

    def name(token: Column) -> Column:
        return F.lower(F.regexp_extract(token, rf"\A{_NESTING}", 1))

    def step(state: Column, token: Column) -> Column:
        def moved(own: Column) -> Column:
            closing = F.startswith(token, F.lit("</"))
            opening = (own != "") & ~closing & ~F.endswith(token, F.lit("/>"))
            inside = state["outer"] != ""
            depth = (
                F.when(~inside, opening.cast("int"))
                .when(state["outer"] != own, state["depth"])
                .otherwise(state["depth"] + F.when(closing, -1).when(opening, 1).otherwise(0))
            )
            return let(
                F.struct(depth.alias("depth"), F.when(inside, state["outer"]).otherwise(own).alias("outer")),
                lambda now: F.struct(
                    F.when(now["depth"] > 0, now["outer"]).otherwise("").alias("outer"),
                    now["depth"].alias("depth"),
                    F.concat(state["shown"], F.when(now["depth"] > 0, "0").otherwise("1")).alias("shown"),
                ),
            )

        return let(name(token), moved)

    start = F.struct(F.lit("").alias("outer"), F.lit(0).alias("depth"), F.lit("1").alias("shown"))

    def shown(found: Column) -> Column:
        return let(
            F.split(F.aggregate(found, start, step)["shown"], ""),
            lambda flags: F.transform(
                F.filter(
                    F.arrays_zip(F.concat(F.array(F.lit("")), found).alias("tag"), F.split(html, TOKEN, -1).alias("gap"), flags.alias("flag")),
                    lambda item: item["flag"] == "1",
                ),
                lambda item: F.struct(item["tag"].alias("tag"), item["gap"].alias("gap")),
            ),
        )

    return let(tokens, shown)


def visible_text(html: Column) -> Column:
    """Text pieces between the markup, stripped and joined by one space."""
    nested = F.transform(_outside_nesting(html), lambda item: item["gap"])
    pieces = F.transform(F.when(html.rlike(_NESTING), nested).otherwise(F.split(html, MARKUP, -1)), lambda piece: strip(decode_entities(piece)))
    return F.array_join(F.filter(pieces, lambda piece: piece != ""), " ")


def raw_title(html: Column) -> Column:
    """Content of the first title outside dropped elements; null without one."""
    kept = F.transform(_outside_nesting(html), lambda item: F.concat(F.when(item["tag"].rlike(_NO_TAG), "").otherwise(item["tag"]), item["gap"]))
    content = let(
        F.when(html.rlike(_NESTING), F.array_join(kept, "")).otherwise(F.regexp_replace(html, NO_TEXT, "")),
        lambda page: F.when(page.rlike(TITLE), F.regexp_extract(page, TITLE, 1)),
    )
    return let(content, decode_entities)
