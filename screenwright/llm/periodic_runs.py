"""Periodic runs of words by branching tandem repeats over an enhanced suffix array.

A run is a stretch with smallest period q, at least twice as long as q, that no neighbouring
word continues. Its last square ``ww`` branches: the word behind it differs from the first of
``w``, so both copies of ``w`` begin in the LCP interval of depth ``len(w)``, in different
children of it. Each interval therefore looks at the suffixes of all its children but the
largest and asks by the inverse suffix array whether the suffix ``depth`` words further on, or
back, lies in the interval too. Squares found so are rotated to the left as far as words
agree, and those that cover the same stretch are merged into the run of smallest period.
Intervals are ranges of the suffix array; no tree is built.

Texts are held side by side as one array, ranks are refined by doubling, and only suffixes
that are still tied are sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from screenwright.llm.common import slices, texts_of

#: Shortest run in words.
LEAST = 12
#: Suffixes of children looked at together.
BLOCK = 1 << 20


def words_of(text: str) -> list[bytes]:
    """Maximal stretches without ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class Suffixes:
    """Suffix array, inverse and LCP of several texts side by side.

    ``ids`` numbers equal words alike within a text; ``lengths`` are words per text, none 0.
    The suffixes of a text fill its own range of the array. ``levels[k]`` has equal numbers
    where the next 2^k words of a text are equal.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        n = len(ids)
        self.ends = np.repeat(np.cumsum(lengths), lengths)
        self.starts = self.ends - np.repeat(lengths, lengths)
        self.levels: list[np.ndarray] = []
        # texts lie one behind the other, so the place where a text begins keeps their words apart
        key = self.starts * (int(ids.max()) + 1) + ids
        self.order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        slots, fresh = np.arange(n), self._changes(key[self.order])
        step = 1
        while True:
            rank[self.order[slots]] = slots[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            self.levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
            slots = slots[~(fresh & np.append(fresh[1:], True))]
            if not len(slots):
                break
            tied = self.order[slots]
            ahead = tied + step
            inside = ahead < self.ends[tied]
            key = rank[tied] * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            by = np.argsort(key, kind="stable")
            self.order[slots] = tied[by]
            fresh = self._changes(key[by])
            step *= 2
        self.rank = rank
        self.lcp = np.zeros(n + 1, np.int64)
        shared = np.flatnonzero(self.levels[0][self.order[1:]] == self.levels[0][self.order[:-1]]) + 1
        self.lcp[shared] = self.forward(self.order[shared - 1], self.order[shared])

    @staticmethod
    def _changes(key: np.ndarray) -> np.ndarray:
        return np.append(True, key[1:] != key[:-1])

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, two different places of one text."""
        i, j, begun = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            inside = np.maximum(i, j) < self.ends[begun]
            same = inside & (level[np.where(inside, i, 0)] == level[np.where(inside, j, 0)])
            i += same << k
            j += same << k
        return i - begun

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words right in front of ``i`` and ``j``, two different places of one text."""
        i, j, begun = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            inside = np.minimum(i, j) - (1 << k) >= self.starts[begun]
            same = inside & (level[np.where(inside, i - (1 << k), 0)] == level[np.where(inside, j - (1 << k), 0)])
            i -= same << k
            j -= same << k
        return begun - i


def _nearest(values: np.ndarray, strictly: bool) -> np.ndarray:
    """For each place the last one before it whose value is smaller (or equal, unless ``strictly``); -1 if none."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    at = np.arange(len(values))
    for k in range(len(tables) - 1, -1, -1):
        begin = at - (1 << k)
        least = tables[k][np.maximum(begin, 0)]
        at = np.where((begin >= 0) & ((least >= values) if strictly else (least > values)), begin, at)
    return at - 1


def _children(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(depth, left, right, child left, child right)`` of all children but the largest of each LCP interval.

    ``lcp[r]`` belongs to the suffixes r - 1 and r; ranges are half open; depth 0 is left out.
    """
    n = len(lcp)
    left, before = _nearest(lcp, True), _nearest(lcp, False)
    right, after = n - 1 - _nearest(lcp[::-1], True)[::-1], n - 1 - _nearest(lcp[::-1], False)[::-1]
    cut = np.flatnonzero(lcp > 0)
    last = cut[after[cut] == right[cut]]  # no further cut of the same interval
    owner = np.concatenate([cut, last])
    begin = np.concatenate([before[cut], last])
    end = np.concatenate([cut, right[last]])
    depth, left, right = lcp[owner], left[owner], right[owner]
    by = np.lexsort((end - begin, depth, left))
    depth, left, right, begin, end = (a[by] for a in (depth, left, right, begin, end))
    same = (left[1:] == left[:-1]) & (depth[1:] == depth[:-1])
    small = np.append(same, False)
    return tuple(a[small] for a in (depth, left, right, begin, end))


def runs_of(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs of at least ``least`` words, places counted over all texts, by start and period."""
    none = np.zeros(0, np.int64)
    if not len(ids):
        return none, none, none
    suffixes = Suffixes(ids, lengths)
    # the first word of a run and the one a period on share half the run: texts without such an LCP hold none
    bounds = np.append(0, np.cumsum(lengths))
    deep = np.maximum.reduceat(suffixes.lcp[:-1], bounds[:-1]) >= (least + 1) // 2
    if not deep.any():
        return none, none, none
    picked = np.flatnonzero(np.repeat(deep, lengths))
    place = np.append(picked, len(ids))  # of the suffix array; the texts' ranges keep their order
    order, lcp = suffixes.order[picked], suffixes.lcp[place]
    slot = np.full(len(ids), -1)
    slot[order] = np.arange(len(order))
    depth, left, right, begin, end = _children(lcp)
    squares, periods = [], []
    total = np.cumsum(end - begin)
    first = 0
    while first < len(depth):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK, side="right")))
        part = slice(first, stop)
        first = stop
        sizes = (end - begin)[part]
        child = np.repeat(np.arange(part.start, part.stop), sizes)
        at = np.arange(len(child)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[child]
        here, d = order[at], depth[child]
        for there, inside in ((here + d, here + d < suffixes.ends[here]), (here - d, here - d >= suffixes.starts[here])):
            found = slot[np.where(inside, there, 0)]
            hit = inside & (found >= left[child]) & (found < right[child]) & ((found < begin[child]) | (found >= end[child]))
            squares.append(np.minimum(here, there)[hit])
            periods.append(d[hit])
    square, period = np.concatenate(squares), np.concatenate(periods)
    start, stop = square - suffixes.backward(square, square + period), square + 2 * period
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    keep = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])) & (stop - start >= least) if len(start) else np.zeros(0, bool)
    start, stop, period = start[keep], stop[keep], period[keep]
    by = np.lexsort((period, start))
    return start[by], stop[by], period[by]


def _collapsed(texts: list[str], least: int) -> tuple[list[list[dict]], list[str]]:
    """Runs of each text, and its words without repeats, joined by one space."""
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, chain.from_iterable(words), count()), np.int64, int(lengths.sum()))
    start, stop, period = runs_of(ids, lengths[lengths > 0], least)
    begins = np.cumsum(lengths) - lengths
    owner = np.searchsorted(begins, start, side="right") - 1
    dropped = np.zeros(len(ids) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, stop, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    runs: list[list[dict]] = [[] for _ in texts]
    for text, a, b, q in zip(owner.tolist(), start.tolist(), stop.tolist(), period.tolist(), strict=True):
        runs[text].append({"start": a - int(begins[text]), "length": b - a, "period": q})
    out = []
    for one, has, at in zip(words, runs, begins.tolist(), strict=True):
        left = compress(one, kept[at : at + len(one)].tolist()) if has else one
        out.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return runs, out


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` plus ``runs`` and ``collapsed`` (columns of these names, in any case, are replaced).

    ``runs`` lists start and length in words (from 0) and period of every run of at least
    ``least`` words, by start, then period. ``collapsed`` has the words that lie in no run
    behind its first period, joined by one space. Texts are read whole. A null or empty text,
    or one of white space alone, has no runs and an empty ``collapsed``; equal texts get
    equal results; an empty table gives an empty one. Nothing is shuffled. A worker holds
    some 2 MB of text at a time, or one text if it is longer: about 150 bytes per word, and
    8 more per word for each doubling of the longest repeated stretch.
    """
    columns = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    given = docs.select(*columns)
    text = next(c for c in columns if c.lower() == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, max_bytes=2 << 20):
            runs, left = _collapsed(texts_of(part, text), least)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, RUNS), pa.array(left, pa.string())], [*part.schema.names, "runs", "collapsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{fields}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
