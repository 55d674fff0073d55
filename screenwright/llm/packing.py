"""Order-preserving packing by dynamic programming over cut points.

Documents are laid end to end. Windows of at most ``size`` tokens may be cut at the
ends of documents and sentences; the cheapest cuts minimise padding plus a penalty for
each document that is cut. The best predecessor of a cut lies in a sliding window, so
a monotone queue finds it in constant time.
"""

from __future__ import annotations

import json
import os
from collections import OrderedDict, deque
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import held, slices

SIZE = 2048
#: Cost, in tokens of padding, of a cut behind a sentence inside a document, and of one inside a sentence.
SENTENCE_CUT, FORCED_CUT = 32, 256
#: Tokens planned at once. The last window of a plan is planned again with what follows.
PLAN_TOKENS = 1 << 18
END_ID = 1
#: Words remembered per Python worker; those not met for longest are forgotten, which costs time only.
REMEMBERED = 1 << 17
#: Words given to the tokenizer at once.
SPELLED = 1 << 10
#: Runs of ids copied at once.
GATHERED = 1 << 16
#: Kinds of bytes: letters (those of the Latin-1 letters from U+00C0 on with them), marks, digits; any other byte keeps its part whole.
LETTER, MARK, DIGIT, OTHER = range(4)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[33:127] = [LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else OTHER if chr(c) == "'" else MARK for c in range(33, 127)]
_KINDS[0x80:0xC0] = _KINDS[0xC3] = LETTER


class WordIds:
    """Ids of a vocabulary whose words never hold white space and end in ``</w>``, as packed 32-bit numbers, remembered by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        model["merges"] = list(map(tuple, model["merges"]))
        #: The library's own memory of words would only be looked through in vain.
        self.tokenizer.model = BPE(cache_capacity=0, **{k: v for k, v in model.items() if k != "type" and v is not None})
        #: The same model for words that are already parted, lower-cased and in byte letters.
        self.by_word = Tokenizer(self.tokenizer.model)
        self.by_word.pre_tokenizer = CharDelimiterSplit(" ")
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.sentence_end, self.word_end = np.zeros((2, max(vocabulary.values()) + 1), bool)
        for token, i in vocabulary.items():
            self.sentence_end[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
            self.word_end[i] = token.endswith("</w>")
        self.memory: OrderedDict[str, bytes] = OrderedDict()

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def spelled(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased words; the tokenizer gets many at a time."""
        found = []
        for k in range(0, len(words), SPELLED):
            letters = " ".join(words[k : k + SPELLED])
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(_LETTERS)
            ids = np.array(self.by_word.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.int32)
            ends = (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist()
            packed = ids.tobytes()
            found += [packed[i:j] for i, j in pairwise([0, *ends])]
        return found

    def remembered(self, words: list[str], whole: list[bool]) -> list[bytes]:
        """Ids of different words; ``whole`` ones are parts of texts that only the whole tokenizer takes apart."""
        memory = self.memory
        found = list(map(memory.get, words))
        known = [ids is not None for ids in found]
        deque(map(memory.move_to_end, compress(words, known)), 0)
        missing = [i for i, is_known in enumerate(known) if not is_known]
        new = [words[i] for i in missing if not whole[i]]
        memory.update(zip(new, self.spelled(new), strict=True))
        for i in missing:
            if whole[i]:
                memory[words[i]] = np.array(self.encoded(words[i]), np.int32).tobytes()
            found[i] = memory[words[i]]
        while len(memory) > REMEMBERED:
            memory.popitem(last=False)
        return found

    def of_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, end to end, and how many each has."""
        lengths = pc.binary_length(parts).to_numpy()
        stops = np.append(0, np.cumsum(lengths))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), "")
        data = np.frombuffer(joined[0].as_buffer(), np.uint8)
        kinds = _KINDS[data]
        accented = np.flatnonzero(data[:-1] == 0xC3) + 1
        kinds[accented[np.isin(data[accented], (0x97, 0xB7))]] = OTHER
        whole = np.diff(np.append(0, np.cumsum(kinds == OTHER))[stops]) > 0
        for token in self.added:
            whole |= pc.match_substring(pc.ascii_lower(parts), token).to_numpy(zero_copy_only=False)
        inside = np.repeat(whole, lengths)
        lower = data + np.uint8(32) * ((data >= 65) & (data <= 90) & ~inside)
        lower[accented] += np.uint8(32) * ((data[accented] < 0x9F) & ~inside[accented])
        begins = np.ones(len(data), bool)
        begins[1:] = ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)) & ~inside[1:]
        begins[stops[:-1][lengths > 0]] = True
        starts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(lower)).dictionary_encode()
        places = words.indices.to_numpy()
        only = np.zeros(len(words.dictionary), bool)
        only[places] = inside[starts[:-1]]
        packed = self.remembered(words.dictionary.to_numpy(zero_copy_only=False).tolist(), only.tolist())
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids = _runs(np.frombuffer(b"".join(packed), np.int32), sizes, places)
        before = np.append(0, np.cumsum(sizes[places]))
        return ids, np.diff(before[np.append(0, np.cumsum(begins))[stops]])

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. White space parts words and carries no id; a null text has none."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
        parts = lists.flatten().dictionary_encode()
        places = parts.indices.to_numpy()
        ids, sizes = self.of_parts(parts.dictionary)
        stops = np.append(0, np.cumsum(sizes[places]))[np.cumsum(pc.list_value_length(lists).to_numpy())]
        return np.split(_runs(ids, sizes, places), stops[:-1])


def _runs(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Runs of ids by their places; run k has ``sizes[k]`` ids and lies behind run k - 1."""
    starts = np.cumsum(sizes) - sizes
    found = [ids[:0]]
    for i in range(0, len(places), GATHERED):
        block = places[i : i + GATHERED]
        counts = sizes[block]
        shift = starts[block] - np.cumsum(counts) + counts
        found.append(ids[np.repeat(shift, counts) + np.arange(counts.sum())])
    return np.concatenate(found)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary; blanks stay, as they part words."""
    plain = [*range(32, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain[1:]]
    return {b: chr(256 + i) for i, b in enumerate(rest)} | {b: chr(b) for b in plain}


_LETTERS = _byte_letters()


def load_words(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def padding(length: int, size: int = SIZE) -> int:
    """Tokens added to a sequence; none at a power of two."""
    return 0 if length & (length - 1) == 0 else size - length


def _power_windows(positions: list[int], size: int) -> tuple[list[int], list[int]]:
    """Begins of windows whose length is a power of two, by end; and where those of each end start in that list."""
    places = np.array(positions) - positions[0]
    index = np.full(places[-1] + 1, -1, np.int32)
    index[places] = np.arange(len(places))
    begins = np.full((len(places), size.bit_length()), -1, np.int32)
    for k in range(size.bit_length()):
        near = np.searchsorted(places, 1 << k)
        begins[near:, k] = index[places[near:] - (1 << k)]
    found = begins >= 0
    return begins[found].tolist(), np.append(0, np.cumsum(found.sum(1))).tolist()


def best_cuts(positions: list[int], penalties: list[int], size: int = SIZE) -> list[int]:
    """The cheapest cuts from the first to the last position, as indexes.

    Neighbouring positions are at most ``size`` apart. A window of length w costs its
    padding and the penalty of its right end.
    """
    n = len(positions)
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])
    exact, first = _power_windows(positions, size)
    reach = [positions[0]] + [0] * (n - 1)  # best + position, what the queue compares
    for j in range(1, n):
        here = positions[j]
        while positions[queue[0]] < here - size:
            queue.popleft()
        source = queue[0]
        cost = reach[source] + size - here
        if first[j] < first[j + 1]:
            for i in exact[first[j] : first[j + 1]]:
                if best[i] <= cost and (best[i] < cost or i < source):
                    cost, source = best[i], i
        cost += penalties[j]
        best[j], back[j] = cost, source
        value = reach[j] = cost + here
        while queue and reach[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class _Packer:
    """Packs the documents of one task, in order, with bounded memory."""

    def __init__(self, sentence_end: np.ndarray, base: int, size: int):
        self.sentence_end, self.next_id, self.size = sentence_end, base, size
        self.waiting: list[tuple] = []  # (doc_id, ids, start in the document, tokens of the document)
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for start in range(0, len(ids), PLAN_TOKENS):
            part = ids[start : start + PLAN_TOKENS]
            self.waiting.append((doc_id, part, start, len(ids)))
            self.tokens += len(part)
            if self.tokens >= PLAN_TOKENS:
                yield from self.plan(False)

    def plan(self, last: bool) -> Iterator[tuple]:
        if not self.tokens:
            return
        cuts: dict[int, int] = {0: 0}
        offset = 0
        sentences = np.flatnonzero(self.sentence_end[np.concatenate([ids for _, ids, _, _ in self.waiting])]) + 1
        cuts.update(dict.fromkeys(sentences.tolist(), SENTENCE_CUT))
        for _, ids, start, total in self.waiting:
            offset += len(ids)
            cuts[offset] = 0 if start + len(ids) == total else FORCED_CUT
        if last:  # the rest may end in short sequences without padding
            for p in range(max(1, offset - self.size), offset):
                cuts.setdefault(p, FORCED_CUT)
        positions = sorted(cuts)
        filled = [0]
        for p in positions[1:]:
            while p - filled[-1] > self.size:
                filled.append(filled[-1] + self.size)
                cuts[filled[-1]] = FORCED_CUT
            filled.append(p)
        ends = [filled[j] for j in best_cuts(filled, [cuts[p] for p in filled], self.size)]
        yield from self.emit(ends if last else ends[:-1])

    def emit(self, ends: list[int]) -> Iterator[tuple]:
        parts = deque(self.waiting)
        begin = 0
        for end in ends:
            offset, room = 0, end - begin
            while offset < room:
                doc_id, ids, start, total = parts.popleft()
                take = min(len(ids), room - offset)
                yield doc_id, start, ids[:take], total, self.next_id, offset
                if take < len(ids):
                    parts.appendleft((doc_id, ids[take:], start + take, total))
                offset += take
            self.next_id += 1
            begin = end
        self.waiting = list(parts)
        self.tokens -= begin


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE) -> DataFrame:
    """Pieces ``doc_id, start, length, input_ids, doc_tokens, sequence_id, offset``.

    A document is its ids and then ``END_ID``; a null or empty text is ``END_ID``
    alone. ``input_ids`` are little-endian unsigned 32-bit numbers. The order of rows
    in a partition is kept and a sequence never leaves its partition. A long document
    is planned in parts, so memory is bounded by one row. Repeated rows and null ids
    are documents like others; an empty table has no pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load_words(tokenizer_path)
        packer = _Packer(words.sentence_end, TaskContext.get().partitionId() << 33, size)

        def pieces() -> Iterator[tuple]:
            for part in slices(batches, "text", max_bytes=1 << 21):
                for doc_id, ids in zip(part.column(0).to_pylist(), words.of(part.column(1)), strict=True):
                    yield from packer.add(doc_id, np.append(ids, np.int32(END_ID)))
                pa.default_memory_pool().release_unused()
            yield from packer.plan(True)

        rows: list[tuple] = []
        for row in pieces():
            rows.append(row)
            if len(rows) == 1024:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    schema = "doc_id long, start long, length long, input_ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
    numbers = [doc, start, [len(i) for i in ids], [i.astype("<u4").tobytes() for i in ids], total, sequence, offset]
    kinds = [pa.binary() if k == 3 else pa.int64() for k in range(7)]
    names = ["doc_id", "start", "length", "input_ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(n, k) for n, k in zip(numbers, kinds, strict=True)], names)
