"""Overlapping chunks with character offsets, one row at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenwright.constants import WHITESPACE
from screenwright.functions.core import PAGE, SPACE, let, note, noted, paged, strip

# Ends of paragraphs, lines and sentences.
BOUNDARY = rf"\n\n|\n|[.!?]{SPACE}+"
RANGES = "array<struct<start:int,end:int>>"
CHUNKS = "array<struct<chunk_index:int,start_char:int,end_char:int,text:string,leading:int>>"

Slice = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class ChunkSettings:
    """Chunk length, overlap and smallest length, in characters.

    With ``keep_tail`` a last piece shorter than ``min_chars`` is joined to the
    chunk before it instead of being left out.
    """

    size: int = 1200
    overlap: int = 150
    min_chars: int = 40
    prefer_boundaries: bool = True
    keep_tail: bool = False

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("size must be at least 1.")
        if self.overlap < 0:
            raise ValueError("overlap cannot be negative.")
        if self.overlap >= self.size:
            raise ValueError("overlap must be smaller than size.")
        if self.min_chars < 1:
            raise ValueError("min_chars must be at least 1.")


def last_boundary(region: Column) -> Column:
    """End of the last boundary inside ``region``, or null."""
    return let(
        F.split(region, BOUNDARY, -1),
        lambda parts: F.when(F.size(parts) > 1, F.length(region) - F.length(F.element_at(parts, -1))),
    )


def _pick_end(part: Slice, start: Column, target: Column, length: Column, settings: ChunkSettings) -> Column:
    if not settings.prefer_boundaries:
        return target
    search = start + settings.min_chars
    found = let(
        F.when((target < length) & (search < target), part(search, target)),
        lambda region: F.when(region.isNotNull(), search + last_boundary(region)),
    )
    return F.coalesce(found, target)


def _ranges(part: Slice, length: Column, settings: ChunkSettings) -> Column:
    """Fold over enough steps to reach the end of a text longer than one chunk.

    Where the next chunk starts depends on where this one ended, so the starts
    are no plain sequence. A boundary can hold the walk back for two steps at
    most; after three it has moved on by ``size - overlap``.
    """
    stride = settings.size - settings.overlap
    steps = F.sequence(F.lit(1), (F.floor(length / stride).cast("int") + 2) * 3)
    begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.lit("").alias("ranges"))

    def advance(state: Column) -> Column:
        start, ranges = state["start"], state["ranges"]
        target = F.least(start + settings.size, length)

        def moved(end: Column) -> Column:
            long_enough = (end - start >= settings.min_chars) | (ranges == "")
            if settings.keep_tail:
                long_enough = long_enough | (end >= length)
            back = end - settings.overlap
            return F.struct(
                F.when(back > start, back).otherwise(end).alias("start"),
                (end >= length).alias("done"),
                F.when(long_enough, note(ranges, start, end)).otherwise(ranges).alias("ranges"),
            )

        return let(_pick_end(part, start, target, length, settings), moved)

    walked = F.aggregate(steps, begin, lambda state, _: F.when(state["done"], state).otherwise(advance(state)))
    whole = let(
        walked,
        lambda state: F.when(state["done"], noted(state["ranges"], "start", "end")).otherwise(
            F.raise_error(F.lit("chunking did not reach the end of the text")).cast(RANGES)
        ),
    )
    return merge_tiny_tail(whole, length, settings.min_chars) if settings.keep_tail else whole


def merge_tiny_tail(ranges: Column, length: Column, min_chars: int) -> Column:
    """Join a last range that ends the text and is shorter than ``min_chars`` to the one before."""

    def merged(items: Column) -> Column:
        count = F.size(items)
        tail, before = F.try_element_at(items, F.lit(-1)), F.try_element_at(items, F.lit(-2))
        tiny = (count >= 2) & (tail["end"] == length) & (tail["end"] - tail["start"] < min_chars)
        joined = F.array(F.struct(before["start"].alias("start"), tail["end"].alias("end")))
        return F.when(tiny, F.concat(F.slice(items, 1, count - 2), joined)).otherwise(items)

    return let(ranges, merged)


def _page(settings: ChunkSettings) -> int:
    return max(PAGE, settings.size)


def _whole(length: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("start"), length.alias("end"))).cast(RANGES)


def chunk_ranges(text: Column, settings: ChunkSettings = ChunkSettings()) -> Column:
    """Character ranges of the chunks of ``text``."""

    # Counting characters reads the whole text, so the length is taken once.
    def ranges(length: Column) -> Column:
        many = paged(text, lambda part: _ranges(part, length, settings), _page(settings))
        short = F.when(length <= settings.size, _whole(length)).otherwise(many)
        return F.when(length == 0, F.array().cast(RANGES)).otherwise(short)

    return F.when(text.isNotNull(), let(F.length(text), ranges))


def chunks_of(text: Column, settings: ChunkSettings = ChunkSettings()) -> Column:
    """Chunks of ``text``: index, range, trimmed text and number of characters trimmed in front.

    Blank chunks are left out but keep their index.
    """

    def cut(part: Slice, ranges: Column) -> Column:
        return F.transform(
            ranges,
            lambda r, i: let(
                part(r["start"], r["end"]),
                lambda raw: F.struct(
                    i.alias("chunk_index"),
                    r["start"].alias("start_char"),
                    r["end"].alias("end_char"),
                    strip(raw).alias("text"),
                    (F.length(raw) - F.length(F.ltrim(raw, F.lit(WHITESPACE)))).alias("leading"),
                ),
            ),
        )

    def pieces(length: Column) -> Column:
        many = paged(
            text,
            lambda part: let(_ranges(part, length, settings), lambda ranges: cut(part, ranges)),
            _page(settings),
        )
        short = F.when(length <= settings.size, cut(lambda start, end: text, _whole(length))).otherwise(many)
        return F.when(length == 0, F.array().cast(CHUNKS)).otherwise(short)

    found = F.when(text.isNotNull(), let(F.length(text), pieces))
    return F.filter(found, lambda chunk: chunk["text"] != "")


def estimate_chunk_count(length: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Number of chunks of a text of this length if no boundary is taken."""
    ChunkSettings(size, overlap)
    more = F.ceil((length - size) / (size - overlap)).cast("int")
    return F.when(length <= 0, F.lit(0)).when(length <= size, F.lit(1)).otherwise(1 + more)


