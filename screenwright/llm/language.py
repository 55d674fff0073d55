"""Language identification by cross-parsing entropy.

A bounded sample of labelled text per language is turned into a suffix automaton. A
text is parsed against each of them into phrases, each the longest match with the
sample from where the last one ended. The fewer phrases per letter, the closer the
text is to the language. A phrase costs the logarithm of the places and symbols it may
name, so that a short sample is not beaten for its shortness; the cheapest parse wins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import held, learnable, slices, texts_of

#: The sample: at most so many documents per language, characters of each, and places all over it that they are from.
SAMPLE_DOCS, SAMPLE_CHARS, PLACES = 64, 600, 6
#: Bytes of all automata of a model. Where the samples need more, as those of 5 languages of full samples and alphabet do, all texts are thinned alike.
MODEL_BYTES = 128 << 20
#: Symbols of a text that are parsed as one row. Phrases end at the row's end.
ROW = 256
#: Letters of the samples with a symbol of their own; each other one is a pair of symbols of its own.
LETTERS = 88
UNKNOWN = "und"


def _from_places(text: Column, chars: int) -> Column:
    """At most so many characters of a text: whole, or a piece at a drawn place in each of ``PLACES`` equal stretches."""
    piece = max(1, chars // PLACES)
    stretch = F.floor(F.length(text) / PLACES)
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(PLACES - 1)),
        lambda k: F.substring(text, (k * stretch + F.pmod(F.xxhash64(F.lit(12), "doc_id", k), F.greatest(stretch - piece, F.lit(0)) + 1) + 1).cast("int"), F.lit(piece)),
    )
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(pieces, " "))


def learn_samples(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Sample texts per language, of rows outside the held-out fold, the same on every run.

    One text is taken per language and hash bucket, the one with the smallest hash, by
    a plain aggregate; a language with a third of all rows is merged before the shuffle.
    A longer text is represented by pieces from all over it.
    """
    usable = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    order = F.xxhash64(F.lit(11), "doc_id", "text")
    found = (
        usable.groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(max_docs)).alias("bucket"))
        .agg(F.min_by(_from_places(F.col("text"), max_chars), order).alias("text"))
        .orderBy("lang", "bucket")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in found:
        samples.setdefault(row["lang"], []).append(row["text"])
    return samples


class Symbols:
    """Numbers for characters: 0 between words, then the frequent letters, the halves of pairs, one for letters no sample holds.

    The halves grow with the square root of the letters that the samples hold, so scripts with
    thousands of letters are told apart letter by letter in a table of bounded width. Numbers are
    bytes; past ``LETTERS`` + 82 * 82 letters the rarest pairs are shared.
    """

    def __init__(self, texts: list[str]):
        counts: dict[str, int] = {}
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        single, paired = letters[:LETTERS], letters[LETTERS:]
        half = min(82, math.isqrt(len(paired) - 1) + 1) if paired else 0
        pairs = len(single) + 1
        number = {c: (i + 1, 0) for i, c in enumerate(single)}
        number.update({c: (pairs + i // half % half, pairs + half + i % half) for i, c in enumerate(paired)})
        self.count = pairs + 2 * half + 1
        self.of, self.then = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.of[code], self.then[code] = number.get(c.lower()[0], (self.count - 1, 0))
        self.paired = bool(paired)

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; what stands between letters is one symbol."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.of[codes]
        if not len(out):
            return out
        kept = (out > 0) | np.append(True, out[:-1] > 0)
        if self.paired:
            then = self.then[codes]
            return np.stack([out, then], 1).ravel()[np.stack([kept, then > 0], 1).ravel()]
        return out[kept]


def suffix_automaton(symbols: list[int], count: int) -> np.ndarray:
    """Transitions ``[state, symbol]`` of all factors of a sequence, -1 where there is none."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p != -1:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(steps), count), -1, np.int32)
    for state, row in enumerate(steps):
        if row:
            table[state, list(row)] = list(row.values())
    return table


def _thinned(symbols: np.ndarray, share: float) -> np.ndarray:
    """A share of a text's symbols, the beginning of each of ``PLACES`` equal stretches."""
    return symbols if share >= 1 else np.concatenate([part[: int(len(part) * share)] for part in np.array_split(symbols, PLACES)])


class Model:
    """Automata of all languages in one table; states of language k start at ``roots[k]``."""

    def __init__(self, samples: dict[str, list[str]], model_bytes: int = MODEL_BYTES):
        self.languages = sorted(samples)
        self.symbols = Symbols([t for texts in samples.values() for t in texts])
        encoded = {language: [self.symbols.encode(t + " ") for t in texts] for language, texts in samples.items()}
        most = model_bytes // (2 * 4 * self.symbols.count)
        share = most / max(1, sum(len(s) for texts in encoded.values() for s in texts))
        roots, at, named = [], 0, []
        # room for the most states that there can be; memory is taken only for those that are written
        table = np.empty((2 * sum(len(s) for texts in encoded.values() for s in texts) + len(self.languages) + 1, self.symbols.count), np.int32)
        for language in self.languages:
            joined = np.concatenate([_thinned(s, share) for s in encoded[language]] or [np.zeros(0, np.uint8)])
            named.append(len(joined) + self.symbols.count)
            own = suffix_automaton(joined.tolist(), self.symbols.count)
            own[own >= 0] += at
            table[at : at + len(own)] = own
            roots.append(at)
            at += len(own)
        table[at] = -1  # behind a symbol that a language lacks
        self.lost = at
        self.table = table[: at + 1].ravel()
        self.roots = np.array(roots, np.int64)
        self.cost = np.log(np.array(named, np.float64))

    def phrases(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases ``[language, row]`` of rows of symbols, parsed side by side; rows go by falling length."""
        k, n, width = len(self.roots), len(rows), self.symbols.count
        columns = np.ascontiguousarray(rows.T)
        state = np.repeat(self.roots[:, None], n, axis=1)
        count = np.ones((k, n), np.int32)
        first = self.table.reshape(-1, width)[self.roots]  # where a phrase goes with its first symbol
        first = np.where(first >= 0, first, self.lost).astype(np.int64)
        alive = n
        for t in range(int(lengths[0]) if n else 0):
            while alive and lengths[alive - 1] <= t:
                alive -= 1
            symbol = columns[t, :alive]
            step = self.table[state[:, :alive] * width + symbol]
            missed = step < 0
            if t:
                count[:, :alive] += missed
            state[:, :alive] = np.where(missed, first[:, symbol], step)
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float | None]]:
        known = [self.symbols.encode(t) for t in texts]
        usable = [i for i, s in enumerate(known) if (s > 0).any()]
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            for i in usable:
                scores[i] = None
        if not self.languages or not usable:
            return languages, scores
        owner = np.concatenate([np.full(-(-len(known[i]) // ROW), i) for i in usable])
        lengths = np.concatenate([np.minimum(ROW, len(known[i]) - np.arange(0, len(known[i]), ROW)) for i in usable])
        rows = np.zeros((len(owner), ROW), np.uint8)
        at = 0
        for i in usable:
            s = known[i]
            n = -(-len(s) // ROW)
            rows[at : at + n].ravel()[: len(s)] = s
            at += n
        order = np.argsort(-lengths, kind="stable")
        counts = np.empty((len(self.languages), len(owner)), np.int32)
        for start in range(0, len(order), 4096):
            part = order[start : start + 4096]
            counts[:, part] = self.phrases(rows[part], lengths[part])
        totals = np.stack([np.bincount(owner, c, minlength=len(texts)) for c in counts])
        bits = totals * self.cost[:, None]
        likelihood = np.exp(bits.min(axis=0) - bits)
        for i in usable:
            best = int(np.argmin(bits[:, i]))
            languages[i] = self.languages[best]
            scores[i] = float(likelihood[best, i] / likelihood[:, i].sum())
        return languages, scores


def identify_language(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """All columns of ``docs`` plus ``lang_pred`` and ``score`` (columns of these names are replaced).

    Only ``text`` decides. ``und`` with score 0 stands for null texts and texts without a letter, and with a null
    score for all others where nothing could be learned; a learned language always has a score above 0, also one
    labelled ``und``. Ties go to the first language by name. Texts of any length are parsed whole, in rows of
    ``ROW`` symbols. Repeated rows get equal answers; an empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    key = hash(tuple((k, tuple(v)) for k, v in sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("language", key), lambda: Model(samples))
        for part in slices(batches, "text", max_bytes=2 << 20):
            languages, scores = model.predict(texts_of(part))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    given = docs.select(*columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{fields}, lang_pred string, score double")
