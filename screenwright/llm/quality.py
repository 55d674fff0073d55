"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a linear function of the shape of the line
and of its neighbours; a transition weight ties adjacent labels. Forward-backward
gives each line's marginal, and a document's score is their mean weighted by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import learnable, slices, texts_of

#: The training sample: at most so many documents of each label, and characters of each, of lines drawn from all over it.
SAMPLE_DOCS, SAMPLE_CHARS = 800, 3000
STEPS, RATE, DECAY = 150, 0.1, 1e-3
THRESHOLD = 0.7

#: Classes of characters.
UPPER, LOWER, DIGIT, SPACE, SHOUT, BAR, STOP, SIGN, FEED = range(9)


def _classes() -> np.ndarray:
    table = np.full(0x110000, SIGN, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = UPPER if c != c.lower() else LOWER
        elif c.isdigit():
            table[code] = DIGIT
        elif c.isspace():
            table[code] = SPACE
    for chars, kind in (("!?", SHOUT), ("|", BAR), (".,;:'\"-()", STOP), ("\n", FEED)):
        for c in chars:
            table[ord(c)] = kind
    return table


_table: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _table:
        _table.append(_classes())
    return _table[0]


#: Odd multipliers, one per place in a word.
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
STEPS_AT = (0.02, 0.1, 0.3, 0.6)


def _repeated_words(codes: np.ndarray, gap: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words of each line equal the word in front of them, by a hash of their characters."""
    begins = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    if not len(begins):
        return np.zeros(len(starts))
    owner = np.concatenate([np.zeros(begins[0], np.int64), np.repeat(begins, np.diff(np.append(begins, len(codes))))])
    place = np.arange(len(codes)) - owner
    mixed = np.where(gap, 0, codes.astype(np.uint64) * _POWERS[place & 63])
    hashes = np.add.reduceat(mixed, begins)
    same = np.append(False, hashes[1:] == hashes[:-1])
    line = np.searchsorted(starts, begins, side="right") - 1
    same &= np.append(False, line[1:] == line[:-1])
    return np.bincount(line[same], minlength=len(starts)).astype(np.float64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features ``[line, feature]`` of all lines, their lengths, and the lines per text."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _class_table()[codes]
    ends = np.flatnonzero(kinds == FEED)
    starts = np.append(0, ends[:-1] + 1)
    width = (ends - starts).astype(np.float64)
    counts = {k: np.add.reduceat(kinds == k, starts, dtype=np.int64).astype(np.float64) for k in (UPPER, LOWER, DIGIT, SPACE, SHOUT, BAR, STOP, SIGN)}
    gap = (kinds == SPACE) | (kinds == FEED)
    words = np.add.reduceat(~gap & np.append(True, gap[:-1]), starts, dtype=np.int64)
    repeats = _repeated_words(codes, gap, starts) / np.maximum(words, 1)
    full = np.maximum(width - counts[SPACE], 1)
    letters = np.maximum(counts[UPPER] + counts[LOWER], 1)
    shares = [counts[UPPER] / letters, *(counts[k] / full for k in (DIGIT, SHOUT, BAR, STOP, SIGN)), (counts[UPPER] + counts[LOWER]) / full]
    marks = [counts[k] / np.maximum(words, 1) for k in (SHOUT, BAR, STOP, SIGN)]
    own = np.stack(
        [
            *shares,
            repeats,
            *(np.minimum(m, 2) for m in marks),
            *((s > at).astype(np.float64) for s in (*shares[:6], repeats, *marks) for at in STEPS_AT),
            np.log1p(width) / 5,
            np.log1p(words) / 4,
            np.minimum(full / np.maximum(words, 1), 20) / 10,
            (width == 0).astype(np.float64),
        ],
        axis=1,
    )
    lines = np.array([t.count("\n") + 1 for t in texts])
    last = np.cumsum(lines) - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[np.append(0, last[:-1] + 1)] = 0
    after[last] = 0
    return np.concatenate([np.ones((len(own), 1)), own, 0.5 * (before + after)], axis=1), width, lines


def _padded(values: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Values of lines as ``[text, position]``, 0 behind the last line."""
    out = np.zeros((len(lines), int(lines.max())))
    out[np.arange(out.shape[1]) < lines[:, None]] = values
    return out


def marginals(evidence: np.ndarray, lines: np.ndarray, tie: float) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(equal to the next) of each line but the last of its text.

    ``evidence`` is the log odds of good by the line alone; ``tie`` is added to the log
    weight of two adjacent equal labels. Texts go side by side, by falling length.
    """
    order = np.argsort(-lines, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    table = np.zeros((len(lines), int(lines.max())))
    mask = np.arange(table.shape[1]) < lines[:, None]
    table[mask] = evidence
    e = np.ascontiguousarray(table[order].T)
    alive = np.add.reduce(np.ascontiguousarray(mask[order].T), axis=1, dtype=np.int64)
    # messages as log odds: passing a tie maps m to log((e^(m+t) + 1) / (e^m + e^t))
    forward, backward = np.zeros_like(e), np.zeros_like(e)

    def passed(m: np.ndarray) -> np.ndarray:
        return np.logaddexp(m + tie, 0) - np.logaddexp(m, tie)

    for t in range(1, len(e)):
        n = alive[t]
        forward[t, :n] = passed(forward[t - 1, :n] + e[t - 1, :n])
        n = alive[len(e) - t]
        backward[len(e) - t - 1, :n] = passed(backward[len(e) - t, :n] + e[len(e) - t, :n])
    odds = e + forward + backward
    good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    a, b = (e + forward)[:-1], (e + backward)[1:]
    same = np.logaddexp(a + b, 0) + tie
    other = np.logaddexp(a, b)
    equal = np.zeros_like(e)
    equal[:-1] = 1 / (1 + np.exp(np.clip(other - same, -500, 500)))
    return good.T[place][mask], equal.T[place][mask]


class LineModel:
    """Weights of the field. Each learned text gives its label to all its lines."""

    def __init__(self, weights: np.ndarray, tie: float):
        self.weights, self.tie = weights, tie

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], weights: list[float] | None = None, steps: int = STEPS) -> LineModel:
        if not texts:
            return cls(np.zeros(0), 0.0)
        x, _, lines = line_features(texts)
        y = np.repeat(np.array(labels, np.float64), lines)
        # a text's weight does not depend on its number of lines
        weight = np.ones(len(texts)) if weights is None else np.array(weights, np.float64)
        share = np.repeat(weight / weight.sum() / lines, lines)
        pairs = np.ones(len(y))
        pairs[np.cumsum(lines) - 1] = 0
        theta = np.zeros(x.shape[1] + 1)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            good, equal = marginals(x @ theta[:-1], lines, theta[-1])
            slope = np.append(x.T @ ((y - good) * share), ((1 - equal) * pairs * share).sum()) - DECAY * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(theta[:-1], float(theta[-1]))

    def scores(self, texts: list[str]) -> list[float]:
        if not texts:
            return []
        if not len(self.weights):
            return [0.5] * len(texts)
        x, width, lines = line_features(texts)
        good, _ = marginals(x @ self.weights, lines, self.tie)
        starts = np.append(0, np.cumsum(lines)[:-1])
        weight = width + 1
        return (np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)).tolist()


def excerpt(text: str, chars: int) -> str:
    """At most so many characters of a text: the lines of lowest hash with their neighbours, in their order.

    The line that passes the bound gives a piece at a drawn place, so that long lines are not passed over.
    """
    if len(text) <= chars:
        return text
    lines = text.split("\n")
    drawn = [xxhash.xxh3_64_intdigest(f"{i} {line}".encode("utf-8", "surrogatepass")) for i, line in enumerate(lines)]
    chosen: dict[int, str] = {}
    for i in sorted(range(len(lines)), key=drawn.__getitem__):
        for j in (i, i - 1, i + 1):
            if not 0 <= j < len(lines) or j in chosen:
                continue
            if len(lines[j]) >= chars:
                at = drawn[j] % (len(lines[j]) - chars + 1)
                chosen[j] = lines[j][at : at + chars]
                return "\n".join(chosen[k] for k in sorted(chosen))
            chosen[j] = lines[j]
            chars -= len(lines[j]) + 1
    return "\n".join(chosen[k] for k in sorted(chosen))


def learn_quality(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> LineModel:
    """A model from a bounded sample of labelled rows outside the held-out fold.

    One document per label and hash bucket, the one with the smallest hash, by a plain
    aggregate; each stands for all labelled rows of its bucket. A longer document is
    represented by lines from all over it. Labels other than 0 and 1, null labels and null texts are passed over.
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    rows = docs.where(learnable(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "text")
    # ids are drawn first, so that no text is shuffled but those of the sample
    drawn = (
        rows.select("doc_id")
        .join(known, "doc_id")
        .groupBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(max_docs)).alias("bucket"))
        .agg(F.min_by("doc_id", F.xxhash64(F.lit(5), "doc_id")).alias("doc_id"), F.count("*").alias("n"))
    )
    given = rows.join(F.broadcast(drawn), "doc_id").select("quality", "bucket", "n", "text")  # at most 2 * max_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=2 << 20):
            texts = pa.array([excerpt(t, max_chars) for t in texts_of(part)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], texts], part.schema.names)

    found = (
        given.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema))
        .groupBy("quality", "bucket", "n")
        .agg(F.min("text").alias("text"))
        .orderBy("quality", "bucket")
        .collect()
    )
    return LineModel.fit([r["text"] for r in found], [r["quality"] for r in found], [r["n"] for r in found])


def score_quality(docs: DataFrame, model: LineModel, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (columns of these names are replaced).

    Only ``text`` decides. A null text is one empty line, like the empty text. A model
    without training rows gives 0.5. Texts are scored whole; repeated rows get equal
    scores; an empty table gives an empty one.
    """
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    given = docs.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=2 << 20):
            scores = model.scores(texts_of(part))
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], [*part.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{fields}, score double, predicted int")
