"""What each of five text filters removes, in every order, from a sparse document-term matrix.

Documents are read once, in shards. A shard numbers its own words and writes each document as
a row of counts by these numbers. All shards' words meet in one table that gives every word
its global number; numbered so, a shard's rows become a matrix in compressed row form. The
sums of its rows (words) and their numbers of entries (distinct words) decide filters A and B.
The other flags are read off the text, or off equal digests, and only counts by part and set
of failed filters are left when the orders are gone through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, remove, scratch, slices

LETTERS = "ABCDE"
#: A document fails with fewer words, a smaller share of distinct words, a larger share of capitals, or one of the signs.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
#: Text of a shard; a longer document is a shard of its own.
SHARD_BYTES = 32 << 20
#: Ranges of the word table that are numbered by themselves.
RANGES = 65536
ROWS = 1 << 16

WHITE, CAPITAL, SIGN = 1, 2, 4
_kinds = np.zeros(256, np.uint8)
_kinds[[32, *range(9, 14)]] = WHITE
_kinds[65:91] = CAPITAL
_kinds[list(SIGNS)] = SIGN

PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` from the 0th on, remembered as far as they were needed."""
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 20), base, np.uint64)))
    return _powers[base][:n]


def distinct_words(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different words of a text that ends in white space, the place of each word among them, and where words begin.

    Words are grouped by a hash and compared byte by byte with the first of their group; should
    two words share a hash, they are grouped in a dictionary.
    """
    codes = np.frombuffer(data, np.uint8)
    white = _kinds[codes] == WHITE
    before = np.append(True, white[:-1])
    begin, end = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    if not len(begin):
        return [], begin, begin
    sums = np.append(np.uint64(0), np.cumsum(codes * _power(PRIME, len(codes))))
    hashes = (sums[end] - sums[begin]) * _power(INVERSE, len(codes))[begin]
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = end - begin, first[which]
    same = bool((size == size[model]).all())
    if same:
        at = np.flatnonzero(~white)
        same = bool((codes[at] == codes[at + np.repeat(begin[model] - begin, size)]).all())
    if same:
        return [data[b:e] for b, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)], which, begin
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(data[b:e], len(number)) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return list(number), which, begin


class _Numbers(dict):
    """Numbers words from 0 as they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of 32-bit numbers between ``bounds`` as binary values."""
    offsets = pa.py_buffer((4 * bounds).astype(np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.astype("<i4"))]).cast(pa.binary())


def _rows(part: pa.RecordBatch, numbers: _Numbers, shard: int) -> dict[str, pa.Array]:
    """One row per document: flags, and its counts by the shard's word numbers (each written as its distance from the one before)."""
    column = part.column(part.schema.get_field_index("text"))
    texts = pc.fill_null(column, "").cast(pa.binary()).to_pylist()
    data = b"\n".join([*texts, b""])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    starts = np.append(0, bounds[:-1])
    words, which, begin = distinct_words(data)
    local = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    row = np.searchsorted(bounds, begin, side="right")
    keys, counts = np.unique((row << 32) + local[which] if len(words) else row, return_counts=True)
    row, terms = keys >> 32, keys & 0xFFFFFFFF
    places = np.searchsorted(row, np.arange(len(texts) + 1))
    steps = np.diff(terms, prepend=0)
    steps[places[:-1][places[:-1] < len(terms)]] = terms[places[:-1][places[:-1] < len(terms)]]
    kinds = _kinds[np.frombuffer(data, np.uint8)]
    capitals = np.add.reduceat(kinds == CAPITAL, starts, dtype=np.int64)
    chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    return {
        "shard": pa.array(np.full(len(texts), shard)),
        "doc_id": part.column(0),
        "part": part.column(1),
        "digest": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
        "c": pa.array(100 * capitals > MOST_CAPITALS * chars),
        "d": pa.array(np.maximum.reduceat(kinds, starts) == SIGN),
        "terms": _binary(steps, places),
        "counts": _binary(counts, places),
    }


_SHARDS = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("c", pa.bool_()), ("d", pa.bool_()), ("terms", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("local", pa.int32())])
_SHARDS_SQL = "shard bigint, doc_id bigint, part string, digest binary, c boolean, d boolean, terms binary, counts binary, word binary, local int"


def _batch(found: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(next(iter(found.values())))
    return pa.RecordBatch.from_arrays([found[f.name].cast(f.type) if f.name in found else pa.nulls(n, f.type) for f in _SHARDS], schema=_SHARDS)


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and behind those of each shard its words with their numbers."""
    shard, held, numbers = TaskContext.get().partitionId() << 32, 0, _Numbers()

    def words() -> Iterator[pa.RecordBatch]:
        found = list(numbers)
        for i in range(0, len(found), ROWS):
            few = found[i : i + ROWS]
            yield _batch({"shard": pa.array(np.full(len(few), shard)), "word": pa.array(few, pa.binary()), "local": pa.array(np.arange(i, i + len(few)))})

    for part in slices(batches, "text"):
        size = part.column(part.schema.get_field_index("text")).nbytes
        if held and held + size > SHARD_BYTES:
            yield from words()
            shard, held, numbers = shard + 1, 0, _Numbers()
        held += size
        yield _batch(_rows(part, numbers, shard))
    yield from words()


_MATRIX_SQL = "doc_id bigint, part string, digest binary, c boolean, d boolean, words bigint, distinct_words bigint"


def compressed_rows(docs: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's matrix: bounds of its rows, global word numbers, and counts."""
    number = np.zeros(words.num_rows, np.int64)
    number[words.column("local").to_numpy()] = words.column("id").to_numpy()
    steps = [np.frombuffer(t, "<i4").astype(np.int64) for t in docs.column("terms").to_pylist()]
    bounds = np.append(0, np.cumsum([len(s) for s in steps])).astype(np.int64)
    terms = np.concatenate([np.cumsum(s) for s in steps]) if steps else np.zeros(0, np.int64)
    counts = np.frombuffer(b"".join(docs.column("counts").to_pylist()), "<i4").astype(np.int64)
    return bounds, number[terms], counts


def _measured(docs: pa.Table, words: pa.Table) -> pa.Table:
    """Words and distinct words of each document of a shard: row sums and entries of its matrix."""
    bounds, _, counts = compressed_rows(docs, words)
    sums = np.append(0, np.cumsum(counts))
    kept = docs.select(["doc_id", "part", "digest", "c", "d"])
    kept = kept.append_column("words", pa.array(sums[bounds[1:]] - sums[bounds[:-1]]))
    return kept.append_column("distinct_words", pa.array(np.diff(bounds)))


def measure_documents(docs: DataFrame, folder: str, part: str = "source") -> DataFrame:
    """Per document ``doc_id, part, digest, c, d, words, distinct_words``, by way of the document-term matrix.

    ``folder`` must not exist and must stay until the result is used.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    given.mapInArrow(_sharded, _SHARDS_SQL).write.option("compression", "zstd").parquet(folder)
    shards = spark.read.parquet(folder)
    # a word has one row per shard, so no word's group outgrows the number of shards
    bucket = F.pmod(F.xxhash64("word"), F.lit(RANGES))
    numbered = shards.where(F.col("word").isNotNull()).select("shard", "local", "word", bucket.alias("bucket"))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word"))
    words = numbered.select("shard", "local", (F.shiftleft(F.col("bucket"), 44) + rank).alias("id"))
    rows = shards.where(F.col("word").isNull()).select("shard", "doc_id", "part", "digest", "c", "d", "terms", "counts")
    return rows.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(_measured, _MATRIX_SQL)


def failure_counts(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by ``part`` and ``failed`` (the letters of the filters they fail): ``n, good, toxic``.

    E needs the smallest id of each text. Documents are merged by digest, part, flags and id first, so copies
    of one text meet as a few sums.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    a = F.col("words") < LEAST_WORDS
    b = 100 * F.col("distinct_words") < LEAST_DISTINCT * F.col("words")
    letters = F.concat(*(F.when(fails, letter).otherwise("") for fails, letter in ((a, "A"), (b, "B"), (F.col("c"), "C"), (F.col("d"), "D"))))
    keys = ["digest", "part", "failed", "good", "toxic"]
    by_id = (
        measured.select("doc_id", "digest", "part", letters.alias("failed"))
        .join(known, "doc_id", "left")
        .groupBy("doc_id", "digest", "part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.count("*").alias("n"))
    )
    groups = by_id.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id")
    )
    lowest = F.min("low").over(Window.partitionBy("digest"))
    first = F.col("without_id") + F.when(F.col("low") == lowest, F.col("at_low")).otherwise(0)
    split = groups.select(*keys, "n", first.alias("first")).select(
        "part",
        "good",
        "toxic",
        F.inline(F.array(F.struct(F.col("failed"), F.col("first").alias("m")), F.struct(F.concat("failed", F.lit("E")).alias("failed"), (F.col("n") - F.col("first")).alias("m")))),
    )
    return split.where("m > 0").groupBy("part", "failed").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("toxic")
    )


def audit_orders(counts: DataFrame) -> DataFrame:
    """Rows of ``audit_filters`` from ``part, failed, n, good, toxic``; 600 rows per part, whatever the documents."""
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(LETTERS))))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))
    laid = counts.select("*", orders.alias("filter_order")).select("*", steps.alias("step"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    fails = F.contains("failed", letter)
    gone = F.length(F.call_function("translate", earlier, F.col("failed"), F.lit(""))) < F.col("step") - 1
    here = fails & ~gone

    def total(of: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(0))

    found = laid.groupBy("part", "filter_order", "step", letter.alias("letter")).agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", here).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("failed") == letter).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    One row per part (value of the column ``part`` of ``docs``; null and the empty string are one), order of
    the five filters and step. A null text counts as empty. Repeated ids are documents of their own; rows that hold
    the smallest id of their text, and rows without id, don't fail E. A document is good (toxic) if any of its
    labels says 1. Further columns are not read; an empty table gives an empty result. The tables between
    stay in the folder that executors share until the counts are made.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "filter-audit")
    counts = checkpointed(failure_counts(measure_documents(docs, folder, part), labels))
    remove(spark, folder)
    return audit_orders(counts)
