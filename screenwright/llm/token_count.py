"""Token counts of a byte-level BPE vocabulary, exact for documents of any length.

Documents up to ``chunk`` characters are one chunk. Longer ones are encoded as
overlapping chunks with offsets and spliced where both encodings of an overlap begin a
word at the same character. Such a boundary is proven stable: the splitting pattern
never looks back, so from a common word start on both encodings see the same words,
provided the left one does not reach its chunk's end. Where no such boundary exists
the overlap is widened.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import slices, texts_of

CHUNK, OVERLAP = 65_536, 256
#: Words remembered per Python worker; a full memory is emptied, which costs time only.
REMEMBERED = 600_000

_loaded: dict[str, tuple] = {}


def load_tokenizer(path: str):
    """The tokenizer of a file and its word counts, once per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = (tokenizer, WordCounts(tokenizer))
    return _loaded[path]


_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _plain(text: str) -> bool:
    """Whether blanks and line feeds are the only white space, and none of them touch."""
    touching = any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
    return not touching and text[:1].strip() == text[:1] and text[-1:].strip() == text[-1:] and text.replace("\n", "").isprintable()


class WordCounts:
    """Token counts of the parts of a text, each remembered.

    A single blank between two characters that are no white space always starts a word
    of the byte-level pattern, and a single line feed there is a word of its own, so
    the parts in between are counted independently. A part of Latin-1 letters with
    marks behind is two words; any other part goes through the whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.parts: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.marks: dict[str, int] = {"": 0}

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def part(self, part: str) -> int:
        """Tokens of a part: one that begins with a line feed has no blank in front, any other has."""
        line = part.startswith("\n")
        body = part[1:] if line else part
        word = body.rstrip(_MARKS)
        if not (word.isalpha() and max(word) < "\u0100"):
            return self.encoded(part if line else " " + part)
        marks = body[len(word) :]
        if marks not in self.marks:
            self.marks[marks] = self.encoded(marks)
        count = None if line else self.words.get(word)
        if count is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            count = len(self.tokenizer.model.tokenize(letters if line else _LETTERS[32] + letters))
            if not line:
                self.words[word] = count
        return line + count + self.marks[marks]

    def of(self, text: str) -> int:
        if _plain(text):
            first, *parts = text.replace("\n", " \n").split(" ")
        else:
            first, *pieces = _CUT.split(text)
            return self.encoded(first) + sum(self.encoded(" " + p) if "\n" in p else self.known([p]) for p in pieces)
        return self.encoded(first) + self.known(parts)

    def known(self, parts: list[str]) -> int:
        try:
            return sum(map(self.parts.__getitem__, parts))
        except KeyError:
            if len(self.parts) > REMEMBERED:
                self.clear()
            for p in parts:
                if p not in self.parts:
                    self.parts[p] = self.part(p)
            return sum(map(self.parts.__getitem__, parts))


def _word_starts(encoded) -> dict[int, int]:
    """Character offset of each word start to the number of tokens before it."""
    starts: dict[int, int] = {}
    last = None
    for i, (word, (begin, _)) in enumerate(zip(encoded.word_ids, encoded.offsets, strict=True)):
        if word != last:
            starts.setdefault(begin, i)
            last = word
    return starts


def _last_sure(encoded, text: str) -> int:
    """Offset behind which the chunk's end may have changed the words."""
    words = [w for w in encoded.word_ids]
    if not words:
        return 0
    at = words.index(words[-1])
    begin = encoded.offsets[at][0]
    while begin and text[begin - 1].isspace():  # the run of white space in front belongs to it
        begin -= 1
    return begin


def spliced_count(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks."""
    total, start = 0, 0
    stop = min(len(text), start + chunk)
    left = tokenizer.encode(text[start:stop], add_special_tokens=False)
    while stop < len(text):
        width = overlap
        while True:
            begin = max(start, stop - width)
            end = min(len(text), begin + max(chunk, 2 * width))
            right = tokenizer.encode(text[begin:end], add_special_tokens=False)
            ours, theirs = _word_starts(left), _word_starts(right)
            sure = _last_sure(left, text[start:stop])
            common = [p for p in theirs if 0 < p + begin - start < sure and p + begin - start in ours]
            # offset 0 of the right chunk is a word start only by its own cut
            common = [p for p in common if p > 0 or begin == start]
            if common:
                cut = max(common)
                total += ours[cut + begin - start]
                break
            if begin == start:  # no stable boundary in the whole chunk: encode it anew, longer
                stop = min(len(text), start + 2 * (stop - start))
                left = tokenizer.encode(text[start:stop], add_special_tokens=False)
                if stop == len(text):
                    return total + len(left)
            width *= 2
        if end == len(text):
            return total + len(right) - theirs[cut]
        start, stop = begin + cut, end
        left = tokenizer.encode(text[start:stop], add_special_tokens=False)
    return total + len(left)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Null texts are empty and have no tokens; repeated rows are counted each; an empty
    table gives an empty one; other columns are not read. Documents with strings of
    special tokens are encoded by the library in one piece, as its default has it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, words = load_tokenizer(tokenizer_path)
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        pattern = re.compile("|".join(special)) if special else None
        for part in slices(batches, "text"):
            texts = texts_of(part)
            tokens = []
            for text in texts:
                if pattern and pattern.search(text):
                    tokens.append(words.encoded(text))
                else:
                    tokens.append(words.of(text) if len(text) <= chunk else spliced_count(text, tokenizer, chunk, overlap))
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
