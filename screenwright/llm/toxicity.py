"""Toxic spans from a linear-chain conditional random field over words.

Every word is toxic or clean. Its evidence is a sum of weights of the word, of its beginnings
and endings and of the words next to it; transition weights tie adjacent labels. The field
learns from labelled words: in clean documents all words are clean, in toxic ones those are
toxic that hold a form found far more often in toxic documents than in clean ones.
Forward-backward gives each word's marginal; a document's score comes from the expected
number and share of toxic words, and runs of words more likely toxic than not are its spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import learnable, slices, texts_of
from screenwright.llm.quality import excerpt

#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 3, 1
#: The training sample: at most so many documents of each label, and characters of each, of lines drawn from all over it.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 2000
#: The document score is fitted on longer excerpts of the same documents, since length matters to it.
JUDGED_CHARS = 20_000
#: Forms of a word and of its neighbours that have a weight; weights are found by hash.
STEMS, TAILS, SLOTS, PRIME = range(2, 9), (3, 4), 1 << 20, 0x9E3779B97F4A7C15
STEPS, RATE, DECAY = 50, 0.15, 1e-6
#: A form is toxic from so many toxic documents, so many times their share among clean ones, and so much evidence (twice the log likelihood ratio) on.
LEAST_DOCS, LEAST_RATIO, LEAST_EVIDENCE = 3, 8.0, 12.0
THRESHOLD = 0.7
#: A larger share of toxic words says no more; few words make large shares.
MOST_SHARE = 0.03
#: Words whose evidence a worker remembers.
REMEMBERED = 400_000
#: Words of a chain that are passed together; chains are cut there and put together again exactly.
LINK = 64
WORD = re.compile(r"[^\W\d_]+")


def _mixed(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Place of the weight of a hashed form; place 0 is kept for absent forms, the last one for the bias."""
    x = hashes + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (1 + (x ^ (x >> np.uint64(31))) % np.uint64(SLOTS - 2)).astype(np.int64)


def word_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of weights, ``[word, form]``: of the lower-case word (column 0), its beginnings, endings, shape and
    length; of it as left neighbour; and as right neighbour.
    """
    low = [w.lower() for w in words]
    size = np.array([len(w) for w in low])
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    powers = np.cumprod(np.full(int(size.max()), PRIME, np.uint64))
    place = np.arange(len(codes)) - np.repeat(begin, size)
    sums = np.append(np.uint64(0), np.cumsum(codes * powers[place]))
    whole = sums[begin + size] - sums[begin]
    made = [_mixed(whole, 0)]
    for k in STEMS:
        end = begin + np.minimum(k, size)
        made.append(np.where(size > k, _mixed(sums[end] - sums[begin], 1), 0))
    for k in TAILS:
        end = begin + size
        at = np.maximum(end - k, begin)
        aligned = (sums[end] - sums[at]) * powers[::-1][np.minimum(at - begin, len(powers) - 1)]
        made.append(np.where(size > k, _mixed(aligned, 2), 0))
    shape = np.array([2 if len(w) > 1 and w.isupper() else 1 if w[:1].isupper() else 0 for w in words], np.uint64)
    made += [_mixed(shape, 3), _mixed(np.minimum(size, 16).astype(np.uint64), 4)]
    return np.stack(made, axis=1), _mixed(whole, 5)[:, None], _mixed(whole, 6)[:, None]


#: Forms that can tell a toxic text: all but shape and length.
TELLING = slice(0, -2)


def _messages(psi: np.ndarray, lengths: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """For each word the odds of toxic that come from the words in front of it.

    ``psi`` is each word's own odds, ``lengths`` the words of each chain (none 0), ``tie[a, b]`` the weight of
    b behind a. Passing a word is a 2x2 matrix; the matrices of LINK words are multiplied side by side for all
    pieces of all chains, the products are passed along each chain, and then each piece is gone through.
    """
    pieces = -(-lengths // LINK)
    first = np.cumsum(pieces) - pieces
    chain = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(chain)) - first[chain]
    begin = (np.cumsum(lengths) - lengths)[chain] + within * LINK
    width = np.minimum(LINK, lengths[chain] - within * LINK)
    mask = np.arange(LINK) < width[:, None]
    table = np.ones((len(chain), LINK))
    table[mask] = psi
    table = np.ascontiguousarray(table.T)
    (c0, c1), (t0, t1) = tie  # behind clean, behind toxic
    a, b, c, d = np.ones(len(chain)), np.zeros(len(chain)), np.zeros(len(chain)), np.ones(len(chain))
    for odds in table:  # [[c0, t0 * odds], [c1, t1 * odds]] times the product so far
        low, high = t0 * odds, t1 * odds
        a, b, c, d = c0 * a + low * c, c0 * b + low * d, c1 * a + high * c, c1 * b + high * d
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
    entry = np.ones(len(chain))
    by = np.argsort(-pieces, kind="stable")
    alive = np.searchsorted(-pieces[by], -np.arange(1, int(pieces.max()) + 1), side="right")
    for k in range(1, len(alive)):
        at = first[by[: alive[k]]] + k
        x = entry[at - 1]
        entry[at] = (c[at - 1] + d[at - 1] * x) / (a[at - 1] + b[at - 1] * x)
    out = np.empty_like(table)
    for t in range(LINK):
        out[t] = entry
        x = entry * table[t]
        entry = (c1 + t1 * x) / (c0 + t0 * x)
    return out.T[mask]


def marginals(evidence: np.ndarray, lengths: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each word, and the odds of toxic that come from in front of it with its own, and from behind with its own.

    ``evidence`` is the log odds by the word alone; ``lengths`` are the words of each chain, none 0.
    """
    psi = np.exp(np.clip(evidence, -30, 30))
    ahead = psi * _messages(psi, lengths, tie)
    ends = np.cumsum(lengths)
    turned = np.repeat(ends - lengths + ends - 1, lengths) - np.arange(len(psi))  # each chain from its end
    behind = _messages(psi[turned], lengths, tie.T)[turned]
    odds = ahead * behind
    return odds / (1 + odds), ahead, behind * psi


def pair_marginals(ahead: np.ndarray, behind: np.ndarray, lengths: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """P(labels a, b) of each word and the next as ``[word, a, b]``, 0 behind a chain's last word."""
    pairs = np.zeros((len(ahead), 2, 2))
    inner = _inner(lengths)
    left, right = ahead[inner], behind[inner + 1]
    pairs[inner, 0, 0], pairs[inner, 0, 1] = tie[0, 0], tie[0, 1] * right
    pairs[inner, 1, 0], pairs[inner, 1, 1] = tie[1, 0] * left, tie[1, 1] * left * right
    pairs[inner] /= pairs[inner].sum(axis=(1, 2), keepdims=True)
    return pairs


def _inner(lengths: np.ndarray) -> np.ndarray:
    """Places of all words but the last of each chain."""
    keep = np.ones(int(lengths.sum()), bool)
    keep[np.cumsum(lengths) - 1] = False
    return np.flatnonzero(keep)


def _neighbours(values: np.ndarray, lengths: np.ndarray, step: int) -> np.ndarray:
    """Of each word the value of the word ``step`` places in front of it in its chain, 0 if there is none."""
    out = np.zeros(len(values))
    ends = np.cumsum(lengths)
    if step > 0:
        out[1:] = values[:-1]
        out[ends - lengths] = 0
    else:
        out[:-1] = values[1:]
        out[ends - 1] = 0
    return out


def label_words(slots: np.ndarray, at: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of all words of labelled texts, from the forms that tell toxic texts from clean ones.

    ``slots`` has the forms of each different word, ``at`` the different word at each place of the texts.
    """
    text = np.repeat(np.arange(len(lengths)), lengths)
    held = np.unique(text[:, None] * SLOTS + slots[at, TELLING])
    clean, toxic = (np.bincount(held[labels[held // SLOTS] == k] % SLOTS, minlength=SLOTS).astype(np.float64) for k in (0, 1))
    total = np.bincount(labels, minlength=2).astype(np.float64)
    share = (clean + toxic) / total.sum()
    evidence = np.zeros(SLOTS)
    for count, of in ((clean, total[0]), (toxic, total[1])):
        for x, expected in ((count, of * share), (of - count, of * (1 - share))):
            evidence += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-9)), 0)
    often = (toxic + 0.5) * (total[0] + 1) >= LEAST_RATIO * (clean + 0.5) * (total[1] + 1)
    telling = (toxic >= LEAST_DOCS) & often & (evidence >= LEAST_EVIDENCE)
    telling[0] = False
    return (telling[slots[:, TELLING]].any(axis=1)[at] & (labels[text] == 1)).astype(np.float64)


class _Numbers(dict):
    """Numbers words from 0 as they are asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class SpanModel:
    """Weights of the field by hashed form, its transitions, and the weights of the document score."""

    def __init__(self, weights: np.ndarray, tie: np.ndarray, judge: np.ndarray):
        self.weights, self.tie, self.judge = weights, tie, judge
        self._forget()

    def _forget(self) -> None:
        self._known = _Numbers()
        self._sums = np.zeros((0, 3))

    def __getstate__(self):
        return self.weights, self.tie, self.judge

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], weights: list[float] | None = None, steps: int = STEPS, max_chars: int = SAMPLE_CHARS) -> SpanModel | None:
        """A model of labelled texts; None without texts of both labels.

        The field learns from at most ``max_chars`` characters of a text. The document score is fitted on
        the texts as given, by a field that did not learn from them: each half judges the other.
        """
        rows = [(t, label, w) for t, label, w in zip(texts, labels, weights or [1.0] * len(texts), strict=True) if WORD.search(t)]
        if len({label for _, label, _ in rows}) < 2:
            return None
        seen = []
        rows.sort(key=lambda r: r[1])
        for k in (0, 1):
            learned, judged = rows[k::2], rows[1 - k :: 2]
            model = cls(*cls._field(learned, steps, max_chars), np.zeros(3))
            found = model._by_text([WORD.findall(t) for t, _, _ in judged])
            seen += [(p.sum(), p.sum() / len(p), label, w) for p, (_, label, w) in zip(found, judged, strict=True)]
        return cls(*cls._field(rows, steps, max_chars), cls._judge(np.array(seen)))

    @staticmethod
    def _field(rows: list[tuple[str, int, float]], steps: int, max_chars: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and transitions by gradient ascent with moving averages of slopes and their squares."""
        words = [WORD.findall(excerpt(t, max_chars)) for t, _, _ in rows]
        labels = np.array([label for _, label, _ in rows])[[len(w) > 0 for w in words]]
        words = [w for w in words if w]
        weights = np.zeros(SLOTS, np.float32)
        if not words:
            return weights, np.ones((2, 2))
        lengths = np.array([len(w) for w in words])
        number = _Numbers()
        at = np.array([number[w] for one in words for w in one])
        tables = word_slots(list(number))
        y = label_words(tables[0], at, lengths, labels)
        inner = _inner(lengths)
        known = np.array([((y[inner] == a) & (y[inner + 1] == b)).sum() for a, b in ((0, 1), (1, 0), (1, 1))], np.float64)
        used = np.unique(np.concatenate([[0, SLOTS - 1], *(t.ravel() for t in tables)]))  # first absent forms, last the bias
        tables = [np.searchsorted(used, t) for t in tables]
        theta, ties = np.zeros(len(used)), np.zeros(3)
        theta[-1] = -4.0
        moved, speed = np.zeros(len(used) + 3), np.zeros(len(used) + 3)
        for step in range(1, steps + 1):
            own, left, right = (theta[t].sum(axis=1)[at] for t in tables)
            evidence = theta[-1] + own + _neighbours(left, lengths, 1) + _neighbours(right, lengths, -1)
            tie = np.exp(np.array([[0.0, ties[0]], [ties[1], ties[2]]]))
            toxic, ahead, behind = marginals(evidence, lengths, tie)
            rest = y - toxic
            slope = np.zeros(len(used))
            for table, found in zip(tables, (rest, _neighbours(rest, lengths, -1), _neighbours(rest, lengths, 1)), strict=True):
                by_word = np.bincount(at, found, len(table))
                slope += np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), len(used))
            slope[-1] = rest.sum()
            slope[0] = 0
            expected = pair_marginals(ahead, behind, lengths, tie).sum(axis=0)
            tie_slope = known - np.array([expected[0, 1], expected[1, 0], expected[1, 1]])
            slope = np.append(slope, tie_slope) - DECAY * len(y) * np.append(theta, ties)
            moved, speed = 0.9 * moved + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
            change = RATE * (moved / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
            theta += change[:-3]
            ties += change[-3:]
        weights[used] = theta
        return weights, np.exp(np.array([[0.0, ties[0]], [ties[1], ties[2]]]))

    @staticmethod
    def _judge(seen: np.ndarray) -> np.ndarray:
        """Logistic regression of the label on expected number and share, by Newton steps."""
        x = SpanModel._terms(seen[:, 0], seen[:, 1])
        y, w = seen[:, 2], seen[:, 3] / seen[:, 3].sum() * len(seen)

        def loss(theta: np.ndarray) -> float:
            odds = x @ theta
            return float((w * (np.logaddexp(0, odds) - y * odds)).sum() + 0.05 * theta @ theta)

        theta = np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
            slope = x.T @ (w * (y - p)) - 0.1 * theta
            move = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(theta)), slope)
            while loss(theta + move) > loss(theta) and np.abs(move).max() > 1e-9:
                move = move / 2
            theta = theta + move
        return theta

    @staticmethod
    def _terms(expected: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(expected)), np.log(expected + 0.1), np.log(np.minimum(share, MOST_SHARE) + 0.001)], axis=1)

    def _marginals(self, words: list[list[str]], lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of all words; ``lengths`` are those of the texts that have words."""
        if len(self._known) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self._known.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        fresh = list(islice(self._known, len(self._sums), None))
        if fresh:
            self._sums = np.concatenate([self._sums, np.stack([self.weights[t].sum(axis=1) for t in word_slots(fresh)], axis=1)])
        own, left, right = self._sums[at].T
        evidence = self.weights[SLOTS - 1] + own + _neighbours(left, lengths, 1) + _neighbours(right, lengths, -1)
        return marginals(evidence, lengths, self.tie)[0]

    def _by_text(self, words: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(one) for one in words], np.int64)
        if not lengths.sum():
            return [np.zeros(0)] * len(words)
        found = self._marginals(words, lengths[lengths > 0])
        return np.split(found, np.cumsum(lengths)[:-1])

    def judge_texts(self, texts: list[str]) -> list[tuple[float, list[dict]]]:
        """Score and spans of each text; spans have code point offsets and their highest marginal."""
        found = self._by_text([WORD.findall(t) for t in texts])
        expected = np.array([p.sum() for p in found])
        share = expected / np.array([max(len(p), 1) for p in found])
        scores = 1 / (1 + np.exp(-np.clip(self._terms(expected, share) @ self.judge, -40, 40)))
        return [(float(s), _spans(t, p) if len(p) and p.max() >= 0.5 else []) for s, t, p in zip(scores, texts, found, strict=True)]


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Stretches of adjacent words that are toxic with a marginal of a half or more."""
    out: list[dict] = []
    before = -2
    places = np.flatnonzero(toxic >= 0.5).tolist()
    wanted = set(places)
    for i, m in enumerate(WORD.finditer(text)):
        if i in wanted:
            if i == before + 1:
                out[-1]["end"] = m.end()
                out[-1]["score"] = max(out[-1]["score"], float(toxic[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(toxic[i])})
            before = i
    return out


def learn_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = JUDGED_CHARS) -> SpanModel | None:
    """A model from a bounded sample of labelled rows outside the held-out fold.

    One document per label and hash bucket, the one with the smallest hash, by a plain aggregate; each stands for
    all labelled rows of its bucket. A longer document is represented by lines from all over it. Rows without id or
    text, labels other than 0 and 1 and ids with both labels are passed over; an id with several texts gives its
    smallest. Without both labels there is no model.
    """
    known = (
        labels.where(learnable(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
        .drop("other")
    )
    rows = docs.where(learnable(F.col("doc_id"), FOLDS, HELD_OUT) & F.col("text").isNotNull()).select("doc_id", "text")
    # ids are drawn first, so that no text is shuffled but those of the sample
    drawn = (
        rows.select("doc_id")
        .join(known, "doc_id")
        .groupBy("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(max_docs)).alias("bucket"))
        .agg(F.min_by("doc_id", F.xxhash64(F.lit(5), "doc_id")).alias("doc_id"), F.count("*").alias("n"))
    )
    given = rows.join(F.broadcast(drawn), "doc_id").select("toxic", "bucket", "n", "text")  # at most 2 * max_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", max_bytes=2 << 20):
            texts = pa.array([excerpt(t, max_chars) for t in texts_of(part)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], texts], part.schema.names)

    found = (
        given.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema))
        .groupBy("toxic", "bucket", "n")
        .agg(F.min("text").alias("text"))
        .orderBy("toxic", "bucket")
        .collect()
    )
    return SpanModel.fit([r["text"] for r in found], [r["toxic"] for r in found], [float(r["n"]) for r in found])


def score_toxicity(docs: DataFrame, model: SpanModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` plus ``score``, ``predicted`` and ``spans`` (columns of these names, in any case, are replaced).

    Only ``text`` decides. ``spans`` holds start and end of toxic stretches in code points (half open) and their
    highest marginal. A text without a letter, empty and null texts have no word: expected number and share 0, no
    span. Without a model scores are 0.5. Texts are scored whole; equal texts get equal scores; an empty table
    gives an empty one.
    """
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted", "spans")]
    given = docs.select(*columns)
    text = next(c for c in columns if c.lower() == "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, max_bytes=2 << 20):
            found = model.judge_texts(texts_of(part, text)) if model else [(0.5, [])] * part.num_rows
            scores = [s for s, _ in found]
            made = pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([x for _, x in found], kind)
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "score", "predicted", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{fields}, score double, predicted int, spans array<struct<start:bigint,end:bigint,score:double>>")
