"""Jaccard join of documents on word n-grams by MinHash banding.

Documents with equal n-gram sets are one class. A class with another one at or above
the threshold shares a band of MinHash values with it, but for the chance stated by
the banding. Bands are shuffled on their hashes; classes connected by shared bands
form candidate groups, whose full n-gram sets are compared in blocks of bounded size.
Links are counted and joined up inside those tasks, so that no table of all pairs of a
group exists.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, free_names, let_go, slices, texts_of
from screenwright.llm.components import connected_components

N, THRESHOLD = 5, 0.8
#: Wanted chance that a pair exactly at the threshold shares a band, and MinHash values per band.
RECALL, ROWS = 0.9999, 5
#: Classes of a candidate group that are compared with each other in one task; a larger group is cut into such blocks, each pair of which is a task's work.
BLOCK = 256
#: Bytes of texts whose n-grams are made at a time; a longer text is a slice by itself.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands that reach the recall at the threshold."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def shingles(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of all texts, end to end, and their number per text.

    Words are the parts of the lower-cased text between ASCII white space. A text with
    fewer than ``n`` words, but at least one, has one n-gram of all its words.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    if not raw:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(blank & np.append(False, ~blank[:-1]))
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)])])
    words = _mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(_U) * _U(0x2545F4914F6CDD1D))
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    first = np.searchsorted(begins, edges)  # number of the first word of each text
    count = np.diff(first)
    grams = np.zeros(len(words), _U)
    for j in range(n):
        step = words[j:]
        grams[: len(step)] = grams[: len(step)] * _U(0xD6E8FEB86659FD93) + step
    grams = _mix(grams)
    owner = np.repeat(np.arange(len(raw)), count)
    whole = np.arange(len(words)) + n <= np.repeat(first[1:], count)
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        h = 0
        for w in words[first[i] : first[i + 1]].tolist():
            h = (h * 0xD6E8FEB86659FD93 + w + 0x632BE59BD9B4E019) % (1 << 64)
        grams[first[i]] = h
        whole[first[i]] = True
    grams, owner = grams[whole], owner[whole]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])) if len(grams) else np.zeros(0, bool)
    return grams[new], np.bincount(owner[new], minlength=len(raw))


def band_hashes(grams: np.ndarray, counts: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes ``[text, band]`` of texts with at least one n-gram."""
    starts = np.append(0, np.cumsum(counts)[:-1])
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 63, size=(bands, rows), dtype=_U) * _U(2) + _U(1)
    terms = rng.integers(0, 1 << 63, size=(bands, rows), dtype=_U)
    out = np.zeros((len(counts), bands), _U)
    for b in range(bands):
        for r in range(rows):
            least = np.minimum.reduceat((grams * factors[b, r]) ^ terms[b, r], starts)
            out[:, b] = _mix(out[:, b] + least)
    return out.view(np.int64)


def _sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, key, bands)`` of each row; key and bands are null where there is no n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, "text", max_bytes=SLICE_BYTES):
            grams, counts = shingles(texts_of(part), n)
            some = np.flatnonzero(counts)
            hashes = band_hashes(grams, counts[some], bands, rows) if len(some) else np.zeros((0, bands), np.int64)
            ends = np.cumsum(counts)
            keys: list[bytes | None] = [None] * len(counts)
            lists: list[np.ndarray | None] = [None] * len(counts)
            for k, i in enumerate(some.tolist()):
                keys[i] = xxhash.xxh3_128_digest(grams[ends[i] - counts[i] : ends[i]].tobytes())
                lists[i] = hashes[k]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "digest", "key", "bands"]
            )

    return docs.mapInArrow(run, "doc_id long, digest binary, key binary, bands array<long>")


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def compare_sets(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets have a Jaccard similarity at or above the threshold, as a symmetric matrix without the diagonal."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, number, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del values
    useful = seen > 1  # n-grams of one set alone are in no intersection
    column = np.cumsum(useful) - 1
    use = useful[number]
    owner, column = owner[use], column[number[use]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, int(useful.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common + 1e-6 >= threshold * union
    np.fill_diagonal(linked, False)
    return linked


def _compare_groups(threshold: float):
    """Links inside each ``(component, i, j)``: a row per class with its number of links and the smallest class it is joined with."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: (r["component"], r["i"], r["j"])):
            # equal rows arrive several times
            yield list({r["class"]: r for r in group}.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        out: list[tuple[int, int, int]] = []
        for group in groups(batches):
            if len(group) > 1:
                linked = compare_sets([np.frombuffer(r["grams"], _U) for r in group], threshold)
                if group[0]["i"] != group[0]["j"]:  # pairs inside a block belong to the block's own task
                    block = np.array([r["block"] for r in group])
                    linked &= block[:, None] != block[None, :]
                ids = [r["class"] for r in group]
                copies = np.array([r["copies"] for r in group])
                parent = list(range(len(group)))
                for i in np.flatnonzero(linked.any(axis=1)).tolist():
                    for j in np.flatnonzero(linked[i, :i]).tolist():
                        a, b = _find(parent, i), _find(parent, j)
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                links = linked @ copies
                out.extend((ids[i], int(links[i]), ids[_find(parent, i)]) for i in np.flatnonzero(links).tolist())
            if len(out) > 10_000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)

    return run


def _link_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["class", "links", "root"])


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(text))


def join_similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_links, component_id, kept`` of every row.

    ``n_links`` counts the other rows whose n-gram set is equal or similar;
    ``component_id`` is the smallest doc_id reachable by links and ``kept`` tells
    whether the row is the one that stands for all of these: the one with the smallest
    id, by the digest of the text where several texts have it; rows equal in both share
    the answer. Null and empty texts have no n-gram and link with nothing, as do rows
    with a null id. Repeated rows link with each other; different texts under one doc_id
    are judged each for itself. Texts are read whole; an empty table gives an empty one;
    other columns are not read. N-grams are compared by 64-bit hashes.
    """
    return _judged(docs, n, threshold, recall, rows, block).drop("digest")


def _judged(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The result of ``join_similar`` with the digest of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", _digest().alias("digest"))
    sketches = checkpointed(_sketches(docs, n, bands_for(threshold, recall, rows), rows))
    usable = sketches.where("key is not null and doc_id is not null")
    # a doc_id may have several texts, so classes have numbers of their own; their rows are found by id and digest
    classes = usable.groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"))
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))
    banded = classes.select("class", F.posexplode("bands").alias("band", "hash"))
    buckets = checkpointed(banded.groupBy("band", "hash").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    near = banded.join(buckets, ["band", "hash"]).where("class <> least").select("class", "least")
    candidates = connected_components(near, "class", "least")
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = checkpointed(sizes)
    members = (
        candidates.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .join(classes.select(F.col("class").alias("id"), "first", "copies"), "id")
        .select("component", "blocks", "block", F.col("id").alias("class"), "copies", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    )
    members = checkpointed(members)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, "text", max_bytes=SLICE_BYTES):
            grams, counts = shingles(texts_of(part), n)
            ends = np.cumsum(counts)
            sets = [grams[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
            names = ["component", "blocks", "block", "class", "copies"]
            columns = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], [*names, "grams"])

    schema = "component long, blocks int, block int, class long, copies long, grams binary"
    texts = docs.join(members, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    sets = texts.select("component", "blocks", "block", "class", "copies", "text").mapInArrow(expand, schema)
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = (
        sets.withColumn("other", partner)
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("component", "i", "j", "block", "class", "copies", "grams")
    )
    dealt = dealt.repartition(F.col("component"), F.col("i"), F.col("j")).sortWithinPartitions("component", "i", "j", "class")
    found = checkpointed(dealt.mapInArrow(_compare_groups(threshold), "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    components = checkpointed(connected_components(found, "class", "root").withColumnRenamed("id", "class"))
    heads = checkpointed(classes.select("class", "first").join(components, "class").groupBy("component").agg(F.min("first").alias("head")))
    per_class = checkpointed(
        classes.select("class", "key", "first", "copies")
        .join(links, "class", "left")
        .join(components.join(heads, "component").drop("component"), "class", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("head", "first").alias("head"))
    )
    (key,) = free_names(sketches, "class_key")
    per_class = per_class.withColumnRenamed("key", key)
    linkable = F.when(F.col("doc_id").isNotNull(), F.col("key"))
    joined = sketches.select("doc_id", "digest", "key").join(per_class, linkable == F.col(key), "left")
    return joined.select(
        "doc_id",
        "digest",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("head.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("head") == F.struct("doc_id", "digest"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, one of each group of similar documents, all columns.

    The row with the smallest id stays, with the smallest digest where this id has
    several similar texts; of several rows with this id and equal text one stays. A row
    goes only for itself: other texts under its id have their own group. Rows that link
    with nothing stay, rows with null ids too.
    """
    digest, turn, gone_id, gone_digest = free_names(docs, "digest_", "turn_", "gone_id_", "gone_digest_")
    dropped = _judged(docs, **settings).where("not kept").select(F.col("doc_id").alias(gone_id), F.col("digest").alias(gone_digest)).distinct()
    given = docs.withColumn(digest, _digest())
    rest = given.join(dropped, (F.col("doc_id") == F.col(gone_id)) & (F.col(digest) == F.col(gone_digest)), "left_anti")
    # the rows are dealt by doc_id and digest already, so numbering equal ones shuffles nothing
    number = F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(digest))
    numbered = rest.withColumn(turn, number)
    return numbered.where((F.col(turn) == 1) | F.col("doc_id").isNull() | F.col(digest).isNull()).drop(digest, turn)
