"""Unicode composition and full text normalisation of DataFrame columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenwright.functions.normalize import normalized
from screenwright.operators.arrow import struct_slices

# The pre-check knows this many of the longest runs of composed characters, and
# every run in the blocks of punctuation and kana. More runs spare more texts
# the Arrow stage but make the check itself slower.
STABLE_RUNS = 24
COMMON_BLOCKS = ((0x2010, 0x206F), (0x3040, 0x30FF))


def _nfkc(*texts: Column) -> list[Column]:
    """The texts' NFKC forms, by one Python stage for all of them."""
    names = [f"c{at}" for at in range(len(texts))]

    @F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in names]))
    def composed(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        normalize = unicodedata.normalize
        for part in struct_slices(rows):
            made = [[t if t is None else normalize("NFKC", t) for t in part.field(at).to_pylist()] for at in range(len(names))]
            yield pa.StructArray.from_arrays([pa.array(column, pa.string()) for column in made], names=names)

    found = composed(F.struct(*(text.alias(name) for text, name in zip(texts, names, strict=True))))
    return [found[name] for name in names]


@lru_cache(maxsize=1)
def may_change_under_nfkc() -> str:
    """Regex class of the characters that NFKC could change or recombine.

    A text whose characters all map to themselves, have combining class zero
    and never join the character before them is already composed. The class is
    the complement of the longest runs of such characters.
    """
    joins = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for point in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(int(parts[1], 16))

    runs: list[tuple[int, int]] = []
    for point in range(0x10000):
        char = chr(point)
        stable = (
            not 0xD800 <= point < 0xE000
            and point not in joins
            and unicodedata.combining(char) == 0
            and unicodedata.category(char) != "Cn"
            and unicodedata.normalize("NFKC", char) == char
        )
        if stable and runs and runs[-1][1] == point - 1:
            runs[-1] = (runs[-1][0], point)
        elif stable:
            runs.append((point, point))
    known = set(sorted(runs, key=lambda run: run[0] - run[1])[:STABLE_RUNS])
    known |= {run for run in runs for low, high in COMMON_BLOCKS if low <= run[0] and run[1] <= high}
    ranges = "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in sorted(known))
    # ASCII fails the first half, so only other characters pay for the list.
    return rf"[\x{{80}}-\x{{10FFFF}}&&[^{ranges}]]"


def compose_unicode(df: DataFrame, *columns: str) -> DataFrame:
    """Replace text columns by their NFKC form.

    Only texts the pre-check cannot clear are sent to the Arrow stage; all
    other rows pass a null, so ASCII data never pays for the transfer.
    """
    check = may_change_under_nfkc()
    found = _nfkc(*(F.when(F.col(name).rlike(check), F.col(name)) for name in columns))
    return df.withColumns({name: F.coalesce(text, F.col(name)) for name, text in zip(columns, found, strict=True)})


def normalize(df: DataFrame, text: str = "text", into: str = "norm", collapse_runs: bool = True) -> DataFrame:
    """Add struct ``into``: normalised text, lengths, removed counts, changed flag."""
    held = "__composed"
    composed = compose_unicode(df.withColumn(held, F.col(text)), held)
    return composed.withColumn(into, normalized(F.col(held), F.length(text), collapse_runs)).drop(held)


def effectively_empty(df: DataFrame, text: str = "text", into: str = "is_empty") -> DataFrame:
    """Flag texts of which normalisation leaves nothing."""
    return normalize(df, text, "__norm").withColumn(into, F.col("__norm.text") == "").drop("__norm")
