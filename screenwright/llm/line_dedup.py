"""Line deduplication with two Bloom filters, for hashes seen once and seen twice.

A first pass over the texts builds, in each task, a bit map of hashes seen in one
document and one of hashes seen in a second. The maps are cut into pages, compressed
and merged page by page; a bit set on both sides of a merge counts as seen twice. Only
lines whose hash passes the merged second filter are shuffled, as 128-bit digests, for
the exact count and the choice of the document that keeps the line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, free_names, let_go

#: What a key is stripped of at both ends.
BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of a filter: 16 a line, between a floor and a ceiling. The ceiling bounds what is sent to every executor (32 MB); past it
#: more lines are suspected and shuffled, the result stays the same.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
PAGES = 32
PROBES = 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None where it has fewer than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _keys(text: str | None, min_chars: int) -> set[bytes]:
    return {k for line in (text or "").encode().split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit numbers of each hash, one row per probe; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return np.stack([(hashes >> np.uint64(32 * i)) * np.uint64(2 * i + 1) & mask for i in range(PROBES)]).astype(np.int64)


def _test(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all probes (rows of ``at``) are set in a packed bit map."""
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    at = np.unique(at)
    if len(at):
        cells, first = np.unique(at >> 3, return_index=True)
        bits[cells] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)


class _Seen:
    """Packed bit maps of one task: hashes seen in some document, and in a second one."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """``hashes``: those of several documents, each hash once per document that has it."""
        hashes, counts = np.unique(hashes, return_counts=True)
        at = _positions(hashes, self.bits)
        _set(self.twice, at[:, (counts > 1) | _test(self.once, at)])
        _set(self.once, at)

    def pages(self) -> Iterator[tuple[int, bytes, bytes]]:
        once, twice = self.once.reshape(PAGES, -1), self.twice.reshape(PAGES, -1)
        for page in range(PAGES):
            if once[page].any():
                yield page, zlib.compress(once[page].tobytes(), 1), zlib.compress(twice[page].tobytes(), 1)


def _page_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    page, once, twice = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["page", "once", "twice"])


def _filters(docs: DataFrame, min_chars: int, bits: int) -> bytes:
    """The merged filter of hashes seen in at least two documents, as bits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        seen = _Seen(bits)
        for batch in batches:
            waiting: list[int] = []
            for text in batch.column(0):
                waiting.extend(xxhash.xxh3_64_intdigest(k) for k in _keys(text.as_py(), min_chars))
                if len(waiting) >= 100_000:
                    seen.add(np.array(waiting, np.uint64))
                    waiting = []
            if waiting:
                seen.add(np.array(waiting, np.uint64))
        for row in seen.pages():
            yield _page_batch([row])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.frombuffer(zlib.decompress(a), np.uint8)
                b = np.frombuffer(zlib.decompress(b), np.uint8)
                if page in once:
                    twice[page] |= b | (once[page] & a)
                    once[page] |= a
                else:
                    once[page], twice[page] = a.copy(), b.copy()
        for page in once:
            yield _page_batch([(page, b"", zlib.compress(twice[page].tobytes(), 1))])

    schema = "page int, once binary, twice binary"
    pages = docs.select("text").mapInArrow(build, schema).repartition(PAGES, "page").mapInArrow(merge, schema)
    whole = np.zeros((PAGES, bits // 8 // PAGES), np.uint8)
    for row in pages.collect():  # PAGES rows, at most MOST_BITS / 8 bytes
        whole[row["page"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


def _filter_bits(docs: DataFrame) -> int:
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = LEAST_BITS
    while bits < min(lines * BITS_PER_LINE, MOST_BITS):
        bits *= 2
    return bits


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(doc_id, digests)``: for each document the 128-bit digests of keys whose lines it loses.

    A key counts once per distinct doc_id. Rows that share a doc_id are one document
    here; a null doc_id is a document too and keeps a line only if no other id has it.
    """
    docs = docs.select("doc_id", "text")
    bits = _filter_bits(docs)
    suspected = docs.sparkSession.sparkContext.broadcast(_filters(docs, min_chars, bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        twice = np.frombuffer(zlib.decompress(suspected.value), np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, keys = [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = _keys(text, min_chars)
                    keys.extend(found)
                    ids.extend([doc_id] * len(found))
                if not keys:
                    continue
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                hit = np.flatnonzero(_test(twice, _positions(hashes, bits))).tolist()
                digests = [xxhash.xxh3_128_digest(keys[i]) for i in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in hit], pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"]
                )

    suspects = checkpointed(docs.mapInArrow(probe, "doc_id long, digest binary").distinct())
    losing = (
        suspects.groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("digest", "keeper")
    )
    losing = checkpointed(losing)
    lost = suspects.join(losing, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, plus ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line and becomes the empty text. Texts of any
    length are handled whole; rows that share a doc_id lose the same lines; an empty
    table gives an empty one. Existing columns of the two names, in any case, are replaced.
    """
    lists = repeated_lines(docs, min_chars, min_docs)
    digests, key = free_names(docs, "digests_", "doc_key_")
    lists = lists.select(F.col("doc_id").alias(key), F.col("digests").alias(digests))
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    joined = docs.select(*columns).join(lists, F.col("doc_id").eqNullSafe(F.col(key)), "left").drop(key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            at, lost_at = batch.schema.get_field_index("text"), batch.schema.get_field_index(digests)
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column(at).to_pylist(), batch.column(lost_at).to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                keep = lines
                if lost:
                    gone = set(lost)
                    keep = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
                texts.append(b"\n".join(keep).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(keep))
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns) if i != lost_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != lost_at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return joined.mapInArrow(cut, f"{fields}, n_lines long, n_dropped long")
