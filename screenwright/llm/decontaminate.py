"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k edits, cut into k + 1 pieces, has a piece
that occurs unchanged. Pieces are a table of 64-bit hashes. A bit map of bounded size
lets the tasks that read the texts send on only places where a piece may stand; these
are joined with the pieces. Places of one item in one text that could touch are merged
into one stretch, and Myers' bit-parallel edit distance runs once over each stretch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, let_go, remove, scratch, slices, texts_of

#: One edit is allowed for each so many characters of the normalised item.
CHARS_PER_EDIT = 16
#: Characters of items whose pieces share one bit map; more items take more passes over the texts.
BLOCK_CHARS = 16_000_000
#: Bits of a bit map for each piece, and at most (32 MB).
PIECE_BITS, MOST_BITS = 128, 1 << 28
#: Places in texts and pieces in items are noted in steps of so many characters.
STEP = 64
#: Characters that are hashed at a time.
SEGMENT = 1 << 17

_OTHER = re.compile(r"[\W_]+")
_U = np.uint64
_BASE, _BASE2, _BASE4 = (_U(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4))
_GRAM = 8


def normalise(text: str) -> str:
    """Lower case; everything between letters and digits becomes one blank."""
    return _OTHER.sub(" ", text.lower()).strip()


def normalise_at(text: str) -> tuple[str, list[int]]:
    """As :func:`normalise`, and for each character the index of its source."""
    out: list[str] = []
    at: list[int] = []
    gap = False
    for i, char in enumerate(text):
        for c in char.lower():
            if c.isalnum():
                if gap and out:
                    out.append(" ")
                    at.append(i)
                gap = False
                out.append(c)
                at.append(i)
            else:
                gap = True
    return "".join(out), at


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` parts of nearly equal length with their offsets."""
    n = edits + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def myers(pattern_bits: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern to any part of a text, and where that part ends."""
    full = (1 << length) - 1
    top = 1 << (length - 1)
    plus, minus, score = full, 0, length
    best, end = length, 0
    for i, char in enumerate(text):
        equal = pattern_bits.get(char, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def bits_of(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, char in enumerate(pattern):
        bits[char] = bits.get(char, 0) | 1 << i
    return bits


def nearest(item: str, edits: int, stretch: str, first: bool, last: bool) -> tuple[int, int, int] | None:
    """``(distance, end, begin)`` of the nearest occurrence within the budget, the first of several.

    Without a budget an occurrence has to stand between word ends; ``first`` and ``last``
    tell whether the stretch begins and ends where its text does.
    """
    at = stretch.find(item)
    if edits == 0:
        while at >= 0:
            end = at + len(item)
            left = first if at == 0 else stretch[at - 1] == " "
            right = last if end == len(stretch) else stretch[end] == " "
            if left and right:
                return 0, end, at
            at = stretch.find(item, at + 1)
        return None
    if at >= 0:
        return 0, at + len(item), at
    distance, end = myers(bits_of(item), len(item), stretch)
    if distance > edits:
        return None
    _, back = myers(bits_of(item[::-1]), len(item), stretch[max(0, end - len(item) - edits) : end][::-1])
    return distance, end, end - back


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of single characters, and of the eight that begin at each place."""
    one = (codes.astype(_U) + _U(1)) * _U(0xC4CEB9FE1A85EC53)
    two = one[:-1] * _BASE + one[1:]
    four = two[:-2] * _BASE2 + two[2:]
    return one, four[:-4] * _BASE4 + four[4:]


def _piece_keys(one: np.ndarray, eight: np.ndarray, starts: np.ndarray, length: int, whole: bool) -> np.ndarray:
    """Hashes of the pieces of one length at the given places. Whole items are told apart from parts."""
    h = np.zeros(len(starts), _U)
    if length < _GRAM:
        for j in range(length):
            h = h * _BASE + one[starts + j]
    else:
        for j in [*range(0, length - _GRAM, _GRAM), length - _GRAM]:
            h = _mix(h * _BASE + eight[starts + j])
    return _mix(h + _U(2 * length + whole))


def _gates(eight: np.ndarray) -> np.ndarray:
    """What the first eight characters of a piece leave in the bit map."""
    return _mix(eight + _U(1))


def _places(keys: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    """Bits of a key, so many."""
    shift = _U(64 - (bits.bit_length() - 1))
    return [((keys * _U(pow(int(_BASE), n, 1 << 64))) >> shift).astype(np.int64) for n in range(probes)]


#: Bits that are set for a gate, and for a piece.
_GATE, _KEY = 2, 4


def _inside(bitmap: np.ndarray, keys: np.ndarray, probes: int) -> np.ndarray:
    seen = np.ones(len(keys), np.uint8)
    for at in _places(keys, len(bitmap) * 8, probes):
        seen &= bitmap[at >> 3] >> (at & 7).astype(np.uint8)
    return seen.astype(bool)


_ITEM = "item_id long, item string, edits int, block int"
_PIECE = "key long, gate long, number long, item_chars int, edits int, step int, length int, whole boolean, block int"
_SUSPECT = "doc_id long, text_id string, text string, block int, keys array<long>, steps array<int>"


def _item_table(benchmark: DataFrame, chars_per_edit: int, block_chars: int) -> DataFrame:
    """Normalised items, numbered; items without a letter or digit are left out."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(i, t, budget(len(t), chars_per_edit), 0) for i, raw in zip(part.column(0).to_pylist(), texts_of(part), strict=True) if (t := normalise(raw))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.int32(), pa.int32()], strict=True)], ["item_id", "item", "edits", "block"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(clean, _ITEM)
    items = checkpointed(items.withColumn("number", F.monotonically_increasing_id()))
    size, rows = items.agg(F.sum(F.length("item").cast("long")), F.count("*")).first()
    blocks = min(-(-(size or 0) // block_chars), rows) or 1
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))


def _piece_table(items: DataFrame) -> DataFrame:
    """One row per piece of each item, written out."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "item", max_bytes=1 << 20):
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for number, item, edits, block in zip(*(c.to_pylist() for c in part.columns), strict=True):
                cuts = pieces(item, edits)
                offsets, lengths = np.array([a for a, _ in cuts]), np.array([len(p) for _, p in cuts])
                one, eight = _grams(_codes(item + "\n" * _GRAM))
                keys, gates = np.zeros(len(cuts), _U), np.zeros(len(cuts), _U)
                for length in np.unique(lengths).tolist():
                    same = lengths == length
                    keys[same] = _piece_keys(one, eight, offsets[same], length, edits == 0)
                    gates[same] = _gates(eight[offsets[same]]) if length >= _GRAM else keys[same]
                n = np.ones(len(cuts), np.int64)
                for column, values in zip(columns, [keys.view(np.int64), gates.view(np.int64), n * number, n * len(item), n * edits, offsets // STEP, lengths, n == (edits == 0), n * block], strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, kinds, strict=True)], names)

    return checkpointed(items.select("number", "item", "edits", "block").mapInArrow(cut, _PIECE))


def _bitmap(part: DataFrame) -> bytes:
    """The bit map of one block's pieces, at most ``MOST_BITS / 8`` bytes however many pieces there are."""
    bits = 1 << 10
    wanted = part.count() * PIECE_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gates = (batch.column(i).to_numpy().view(_U) for i in (0, 1))
            at = np.unique(np.concatenate(_places(keys, bits, _KEY) + _places(gates, bits, _GATE)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bit"])

    words = part.select("key", "gate").mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    whole = np.zeros(bits // 32, np.uint32)
    whole[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return whole.astype("<u4").tobytes()


def _suspected(bitmap, kinds: list[tuple[int, bool]], block: int) -> Callable:
    """Texts with the steps at which a piece may stand, by the bit map."""
    reach = max((length for length, _ in kinds), default=0) + _GRAM

    def places(codes: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for base in range(1, len(codes) - reach, SEGMENT):
            part = codes[base : base + SEGMENT + reach]
            before = codes[base - 1 : base - 1 + len(part)]
            one, eight = _grams(part)
            size = min(SEGMENT, len(part) - reach)
            gated = np.flatnonzero(_inside(bits, _gates(eight[:size]), _GATE)) if any(length >= _GRAM for length, _ in kinds) else None
            for length, whole in kinds:
                starts = gated if length >= _GRAM else np.arange(size)
                if whole:
                    starts = starts[(before[starts] <= 32) & (part[starts + length] <= 32)]
                keys = _piece_keys(one, eight, starts, length, whole)
                found = _inside(bits, keys, _KEY)
                yield starts[found] + base, keys[found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        bits = np.frombuffer(bitmap.value, np.uint8)
        for part in slices(batches, "text", max_bytes=1 << 20):
            texts = texts_of(part)
            clean = [normalise(t) for t in texts]
            ends = np.cumsum([1] + [len(t) + 1 for t in clean])
            found = list(places(_codes("\n" + "\n".join(clean) + "\n" * (reach + 1)), bits))
            at = np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)])
            if not len(at):
                continue
            keys = np.concatenate([k for _, k in found])
            row = np.searchsorted(ends, at, "right") - 1
            spots = np.unique(np.rec.fromarrays([row, keys, (at - ends[row]) // STEP], names="row,key,step"))
            rows, first, sizes = np.unique(spots.row, return_index=True, return_counts=True)
            ids = part.column(0).take(pa.array(rows))
            offsets = pa.array(np.append(first, len(spots)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([hashlib.sha256(texts[r].encode()).hexdigest() for r in rows]),
                    pa.array([texts[r] for r in rows]),
                    pa.array(np.full(len(rows), block), pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(spots.key.view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(spots.step, pa.int32())),
                ],
                [c.split()[0] for c in _SUSPECT.split(", ")],
            )

    return run


def _clean_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for part in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([normalise(t) for t in texts_of(part)])], ["text_id", "clean"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for part in slices(batches, "stretch"):
        rows = []
        for text_id, number, item, edits, low, last, stretch in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found = nearest(item, edits, stretch, low == 0, last)
            if found:
                rows.append((text_id, number, found[0], low + found[1], low + found[2]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["text_id", "number", "distance", "end", "begin"])


def _stretches(suspects: DataFrame, parts: DataFrame) -> DataFrame:
    """``text_id, number, low, high``: where items may stand, in characters of the normalised text, none touching another."""
    spots = suspects.select("text_id", F.explode(F.arrays_zip("keys", "steps")).alias("s")).select("text_id", F.col("s.keys").alias("key"), F.col("s.steps").alias("text_step")).distinct()
    parts = parts.select("key", "number", "item_chars", "edits", "step").distinct()
    # a piece at step t of the text and s of the item: the item begins within STEP - 1 characters of (t - s) * STEP
    start = (F.col("text_step") - F.col("step")).cast("long") * STEP
    low = F.greatest(start - STEP - 2 * F.col("edits"), F.lit(0).cast("long"))
    high = start + STEP + F.col("edits") + F.col("item_chars") + 1
    each = spots.join(parts, "key").select("text_id", "number", low.alias("low"), high.alias("high")).distinct()
    order = Window.partitionBy("text_id", "number").orderBy("high")
    opens = F.coalesce((F.col("low") > F.lag("high").over(order)).cast("int"), F.lit(0))
    runs = each.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("text_id", "number", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("run")


def _search(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int, block_chars: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The suspected rows, what was found in each of their texts, the items, and the folder that holds the first two."""
    spark = docs.sparkSession
    items = _item_table(benchmark, chars_per_edit, block_chars)
    parts = _piece_table(items)
    folder = scratch(spark, "decontaminate")
    kinds: dict[int, list[tuple[int, bool]]] = {}
    for row in parts.select("block", "length", "whole").distinct().collect():  # lengths up to chars_per_edit, for each block
        kinds.setdefault(row["block"], []).append((row["length"], row["whole"]))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    suspects = spark.createDataFrame([], _SUSPECT)
    for block, lengths in sorted(kinds.items()):
        sent = spark.sparkContext.broadcast(_bitmap(parts.where(F.col("block") == block)))
        suspects = suspects.unionByName(narrow.mapInArrow(_suspected(sent, lengths, block), _SUSPECT))
    suspects.write.parquet(f"{folder}/suspects")
    suspects = spark.read.schema(_SUSPECT).parquet(f"{folder}/suspects")

    where = _stretches(suspects, parts)
    texts = suspects.select("text_id", "text").dropDuplicates(["text_id"]).mapInArrow(_clean_texts, "text_id string, clean string")
    size = (F.col("high") - F.col("low")).cast("int")
    shown = where.join(texts, "text_id").select("text_id", "number", "low", F.substring("clean", (F.col("low") + 1).cast("int"), size).alias("stretch"), (F.col("high") >= F.length("clean")).alias("last"))
    rows = shown.join(items.select("number", "item", "edits"), "number").select("text_id", "number", "item", "edits", "low", "last", "stretch")
    found = rows.mapInArrow(_verify, "text_id string, number long, distance int, end long, begin long")
    best = found.groupBy("text_id", "number").agg(F.min(F.struct("distance", "end", "begin")).alias("b")).select("text_id", "number", "b.*")
    best.write.parquet(f"{folder}/found")
    return suspects, spark.read.parquet(f"{folder}/found"), items, folder


def _source_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for part in slices(batches, "text"):
        rows = []
        for text_id, found, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part), strict=True):
            _, at = normalise_at(text)
            rows.extend((text_id, f["number"], f["distance"], at[f["begin"]], at[f["end"] - 1] + 1) for f in found)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["text_id", "number", "distance", "begin", "end"])


def find_items(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, begin, end, distance, budget_edits``, one row per document and item found in it.

    ``begin`` and ``end`` are code points of the original text: the nearest occurrence,
    the first to end of several. Equal texts are searched once. Null and empty texts
    hold nothing; null and empty items are found nowhere; repeated documents or items
    are reported each; documents with a null id too. Items shorter than
    ``chars_per_edit`` have to occur unchanged between word ends. Other columns are not
    read. The texts of suspected documents are written below the checkpoint folder and
    removed before this returns.
    """
    suspects, found, items, folder = _search(docs, benchmark, chars_per_edit, block_chars)
    texts = suspects.select("text_id", "text").dropDuplicates(["text_id"])
    grouped = found.groupBy("text_id").agg(F.collect_list(F.struct("number", "distance", "begin", "end")).alias("found"))
    placed = grouped.join(texts, "text_id").select("text_id", "found", "text").mapInArrow(_source_places, "text_id string, number long, distance int, begin long, end long")
    named = placed.join(items.select("number", "item_id", "edits", "block"), "number")
    out = suspects.select("doc_id", "text_id", "block").join(named, ["text_id", "block"])
    out = checkpointed(out.select("doc_id", "item_id", "begin", "end", "distance", F.col("edits").alias("budget_edits")))
    remove(docs.sparkSession, folder)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged. Null and empty texts stay.

    The digests of texts with an item are a written table, so that Spark knows their
    size: few are sent to all tasks and no document is shuffled, many are shuffled.
    ``docs`` is read twice.
    """
    _, found, _, folder = _search(docs, benchmark, chars_per_edit, block_chars)
    remove(docs.sparkSession, f"{folder}/suspects")
    dirty = found.select("text_id").distinct()
    return docs.join(dirty, F.sha2(docs["text"].cast("binary"), 256) == dirty["text_id"], "left_anti")
