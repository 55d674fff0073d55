"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors are dealt into shards. The task of a shard builds a graph of hubs, which finds
the buckets of vectors that a query is compared with, for queries of its own and of
other shards; of each two shards one asks the other. Before it answers, a task audits
its beam against brute force and widens it until the recall is met; a query that has
links behind the first quarter of its beam gets a wider one. Links near the threshold
are verified in double precision, links are counted in the task for both ends, and only
the links of a spanning forest leave it, to be joined into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, let_go
from screenwright.llm.components import connected_components

THRESHOLD = 0.9
#: Shards: at least so many, and enough that none has more than so many vectors, or bytes of them and their graph.
SHARDS, SHARD_ROWS, SHARD_BYTES = 8, 500_000, 1 << 30
#: Neighbours of a hub above and on the lowest level, beam while building, first beam of a query, also of a member that
#: looks for its hub; a shard of n vectors has as many hubs as the root of n.
NEIGHBOURS, LOWEST, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: The audit: so many members, each moved to the threshold's edge, of which this share has to be found.
AUDIT, RECALL = 256, 0.98
#: Nodes expanded per step, and bytes for the marks of visited nodes.
EXPAND, MARK_BYTES = 4, 32 << 20
#: Queries with links late in their beams are compared with all members, in blocks of so many values, once a
#: wider beam would cost more: a step along links costs as much as so many values of a matrix product.
STEP_COST, BLOCK_VALUES = 16, 4 << 20
#: Queries answered at once, linked pairs counted at once, and rows told at once.
BLOCK_ROWS, PAIRS, TOLD_ROWS = 16384, 1 << 20, 65536


class Graph:
    """A navigable small-world graph over unit vectors, built and searched for many queries side by side."""

    def __init__(self, vectors: np.ndarray, seed: int = 3):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        self.order = np.argsort(-level, kind="stable")  # upper nodes first: each level is a prefix of the order
        self.top = int(level.max()) if n else 0
        self.links = [np.full((n, LOWEST if at == 0 else NEIGHBOURS), -1, np.int32) for at in range(self.top + 1)]
        self.counts = [int((level >= at).sum()) for at in range(self.top + 1)]
        self.rows = max(8, min(512, MARK_BYTES // (n + 1)))
        done = 0
        while done < n:
            batch = self.order[done : done + max(1, min(done or 64, self.rows))]
            self._insert(batch, level, done)
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, done: int) -> None:
        q = self.x[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        entry = np.full((len(batch), 1), self.order[0]) if done else np.zeros((len(batch), 0), int)
        for at in range(self.top, -1, -1):
            if done:
                found, sims = self._beam(q, entry, at, BUILD_BEAM if level[batch].max() >= at else 1)
                entry = found[:, :8]
            own = np.flatnonzero(level[batch] >= at)
            if not len(own):
                continue
            # candidates: the beam, and the nearest of the batch
            near = min(BUILD_BEAM // 2, len(own))
            inner = among[np.ix_(own, own)]
            best = np.argsort(-inner, axis=1)[:, :near]
            ids, values = batch[own][best], np.take_along_axis(inner, best, 1)
            if done:
                ids, values = np.concatenate([found[own], ids], axis=1), np.concatenate([sims[own], values], axis=1)
            order = np.argsort(-values, axis=1)
            ids, values = np.take_along_axis(ids, order, 1), np.take_along_axis(values, order, 1)
            ids = np.where(np.isfinite(values), ids, -1)
            links = self.links[at]
            chosen = self._diverse(ids, values, links.shape[1])
            links[batch[own]] = chosen
            self._link_back(at, batch[own], chosen)

    def _diverse(self, ids: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by falling similarity, those nearer to the query than to one chosen before; the rest fills up."""
        b, c = ids.shape
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        nearest = np.full((b, c), -np.inf, np.float32)
        rank = np.full((b, c), 2 * c)
        for j in range(c):
            good = (ids[:, j] >= 0) & (values[:, j] > nearest[:, j])
            rank[:, j] = np.where(good, j, np.where(ids[:, j] >= 0, c + j, 3 * c))
            np.maximum(nearest, np.where(good[:, None], between[:, :, j], -np.inf), out=nearest)
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(rank, pick, 1) < 2 * c, np.take_along_axis(ids, pick, 1), -1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((b, most - out.shape[1]), -1)], axis=1)
        return out

    def _link_back(self, at: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[at]
        width = links.shape[1]
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts = np.unique(target, return_index=True)
        sizes = np.diff(np.append(starts, len(target)))
        for begin in range(0, len(nodes), 512):
            part, size, start = nodes[begin : begin + 512], sizes[begin : begin + 512], starts[begin : begin + 512]
            new = np.full((len(part), int(size.max())), -1)
            row = np.repeat(np.arange(len(part)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            new[row, place] = source[np.repeat(start, size) + place]
            ids = np.concatenate([links[part], new], axis=1)
            values = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[ids], self.x[part]), -np.inf)
            ids.sort(axis=1)
            values = np.where(ids >= 0, np.einsum("bcd,bd->bc", self.x[ids], self.x[part]), -np.inf)
            values[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
            values[ids == part[:, None]] = -np.inf
            best = np.argsort(-values, axis=1)[:, : max(width, min(ids.shape[1], 2 * width))]
            ids, values = np.take_along_axis(ids, best, 1), np.take_along_axis(values, best, 1)
            links[part] = self._diverse(np.where(np.isfinite(values), ids, -1), values, width)

    def _beam(self, q: np.ndarray, entry: np.ndarray, at: int, width: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found from the entries, by falling similarity; -1 where there are fewer.

        ``known`` has the similarities of the queries to all nodes, if they are cheaper than those along the links.
        """
        links, n, b = self.links[at], len(self.x), len(q)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True
        line = np.arange(b)[:, None]
        entry = np.where(entry < 0, n, entry)
        entry = np.sort(entry, axis=1)
        fresh = entry < n
        fresh[:, 1:] &= entry[:, 1:] != entry[:, :-1]
        ids = np.where(fresh, entry, -1)
        sims = np.einsum("bcd,bd->bc", self.x[ids], q) if known is None else known[line, ids]
        sims = np.where(fresh, sims, -np.inf).astype(np.float32)
        seen[line, entry] = True
        open_ = fresh.copy()
        width_now = max(width, ids.shape[1])
        pad = width_now - ids.shape[1]
        ids = np.concatenate([ids, np.full((b, pad), -1)], axis=1)
        sims = np.concatenate([sims, np.full((b, pad), -np.inf, np.float32)], axis=1)
        open_ = np.concatenate([open_, np.zeros((b, pad), bool)], axis=1)
        active = np.arange(b)
        while len(active):
            value = np.where(open_[active], sims[active], -np.inf)
            pick = np.argpartition(-value, EXPAND - 1, axis=1)[:, :EXPAND] if width_now > EXPAND else np.tile(np.arange(width_now), (len(active), 1))
            good = np.isfinite(np.take_along_axis(value, pick, 1))
            going = good.any(axis=1)
            active, pick, good = active[going], pick[going], good[going]
            if not len(active):
                break
            row = active[:, None]
            nodes = ids[row, pick]
            open_[row, pick] = False
            around = np.where(good[:, :, None], links.take(nodes, axis=0), -1).reshape(len(active), -1)
            around = np.where(around < 0, n, around)
            around[seen.take(row * (n + 1) + around)] = n
            around.sort(axis=1)
            around = around[:, : max(1, int((around < n).sum(axis=1).max()))]
            around[:, 1:][around[:, 1:] == around[:, :-1]] = n
            seen.ravel()[row * (n + 1) + around] = True
            there = np.minimum(around, n - 1)
            close = np.einsum("bcd,bd->bc", self.x[there], q[active]).astype(np.float32) if known is None else known.take(row * n + there)
            close[around == n] = -np.inf
            all_ids = np.concatenate([ids[active], around], axis=1)
            all_sims = np.concatenate([sims[active], close], axis=1)
            all_open = np.concatenate([open_[active], np.isfinite(close)], axis=1)
            best = np.argpartition(-all_sims, width_now - 1, axis=1)[:, :width_now]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-sims, axis=1)[:, :width]
        sims = np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), np.take_along_axis(ids, order, 1), -1), sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q = np.ascontiguousarray(q, np.float32)
        entry = np.full((len(q), 1), self.order[0])
        known = q @ self.x.T if len(self.x) <= STEP_COST * LOWEST * beam else None
        for at in range(self.top, 0, -1):
            entry, _ = self._beam(q, entry, at, 4, known)
        return self._beam(q, entry, 0, beam, known)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Shard:
    """The vectors of a shard in buckets, each of those nearest to one hub, and the graph of the hubs.

    A query takes the buckets of the hubs that the graph finds, by one product for all queries of a bucket. ``gained``
    counts the links of members that others have asked for.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, threshold: float):
        n, d = vectors.shape
        self.threshold, self.block = threshold, max(1, min(BLOCK_ROWS, BLOCK_VALUES // d))
        hubs = np.sort(np.random.default_rng(5).permutation(n)[: math.isqrt(n)])
        self.graph = Graph(_unit(vectors[hubs]))
        found = np.empty((n, BEAM), np.int32)
        for part in self._blocks(n):
            found[part] = self._found(_unit(vectors[part]).astype(np.float32), BEAM)
        order = np.argsort(found[:, 0], kind="stable")
        self.hubs = found[order]
        self.hub, self.ids, self.exact, self.copies = self.hubs[:, 0].copy(), ids[order], vectors[order], copies[order]
        self.starts = np.searchsorted(self.hub, np.arange(len(hubs) + 1))
        self.x = np.empty((n, d), np.float32)
        for part in self._blocks(n):
            self.x[part] = _unit(self.exact[part])
        self.parent, self.gained = np.arange(n), np.zeros(n, np.int64)
        self.beam = self._audited(BEAM)

    def _blocks(self, n: int) -> Iterator[slice]:
        for start in range(0, n, self.block):
            yield slice(start, min(n, start + self.block))

    def _found(self, q: np.ndarray, beam: int) -> np.ndarray:
        """The hubs of a beam for each query, by falling similarity; -1 where there are fewer."""
        rows = self.graph.rows
        return np.concatenate([self.graph.search(q[start : start + rows], beam)[0] for start in range(0, len(q), rows)])

    def _audited(self, beam: int) -> int:
        """The first beam, half as wide again each time, that finds members from queries at the threshold's edge."""
        n, d = self.exact.shape
        rng = np.random.default_rng(9)
        chosen = rng.permutation(n)[:AUDIT]
        side = rng.normal(size=(len(chosen), d))
        base = _unit(self.exact[chosen])
        side -= (side * base).sum(axis=1, keepdims=True) * base
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        edge = self.threshold + 1e-4
        q = edge * base + np.sqrt(max(0.0, 1 - edge**2)) * side / np.where(norm > 0, norm, 1)
        # the hubs in whose buckets the links of a query are, and how many
        true = np.zeros((len(q), len(self.starts) - 1), np.int64)
        for part in self._blocks(n):
            row, member = np.nonzero(q @ _unit(self.exact[part]).T >= self.threshold)
            np.add.at(true, (row, self.hub[part][member]), 1)
        q = q.astype(np.float32)
        while beam < true.shape[1]:
            hubs = self._found(q, beam)
            links = np.where(hubs >= 0, np.take_along_axis(true, hubs, 1), 0)
            hit, all_ = links.sum(axis=1), true.sum(axis=1)
            final = (hit == all_) | ~links[:, beam // 4 :].any(axis=1)  # other beams have late links and get wider ones
            if hit[final].sum() >= RECALL * all_[final].sum():
                return beam
            beam += beam // 2
        return true.shape[1]

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        """The smallest node of the group of each node, as far as groups are known."""
        roots = self.parent[nodes]
        while True:
            above = self.parent[roots]
            if (above == roots).all():
                self.parent[nodes] = roots
                return roots
            roots = above

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the groups of each two nodes together."""
        while True:
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def _near(self, q: np.ndarray, narrow: np.ndarray, rows: np.ndarray, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``(place in rows, member)`` that link, of the queries ``rows`` and the members from ``start`` on."""
        step = max(1, BLOCK_VALUES // max(1, stop - start))
        for at in range(0, len(rows) if start < stop else 0, step):
            sims = (narrow[rows[at : at + step]] @ self.x[start:stop].T).ravel()
            close = np.flatnonzero(sims >= self.threshold - 1e-3)
            for begin in range(0, len(close), PAIRS):
                found = close[begin : begin + PAIRS]
                edge = np.flatnonzero(sims[found] < self.threshold + 1e-3)
                place, member = np.divmod(found, stop - start)
                place, member = place + at, member + start
                right = np.ones(len(found), bool)
                for first in range(0, len(edge), self.block):
                    few = edge[first : first + self.block]
                    right[few] = (_unit(self.exact[member[few]]) * q[rows[place[few]]]).sum(axis=1) >= self.threshold
                yield place[right], member[right]

    def own(self) -> Iterator[tuple[int, int, int]]:
        """``answer`` for the members themselves, whose first beams are known; once only."""
        hubs, self.hubs = self.hubs, None
        for part in self._blocks(len(self.ids)):
            yield from self._answered(self.ids[part], _unit(self.exact[part]), None, hubs[part] if self.beam == BEAM else None)

    def answer(self, ids: np.ndarray, q: np.ndarray, copies: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """``(id, links, one linked id)`` of each query with links in this shard.

        With ``copies`` of the queries, which then do not get asked by the members, the members gain these links too.
        """
        for part in self._blocks(len(q)):
            yield from self._answered(ids[part], q[part], None if copies is None else copies[part])

    def _answered(self, ids: np.ndarray, q: np.ndarray, copies: np.ndarray | None, known: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
        """``answer`` of a block; ``known`` has the hubs of the first beam."""
        count = len(self.starts) - 1
        narrow, links, first = q.astype(np.float32), np.zeros(len(q), np.int64), np.full(len(q), -1)

        def note(row: np.ndarray, member: np.ndarray) -> np.ndarray:
            other = self.ids[member] != ids[row]
            row, member = row[other], member[other]
            np.add.at(links, row, self.copies[member])
            if copies is not None:
                np.add.at(self.gained, member, copies[row])
            fresh = first[row] < 0
            first[row[fresh]] = member[fresh]
            self._join(member, first[row])
            return other

        # row * count + hub of what the waiting queries have been compared with
        waiting, beam, before = np.arange(len(q)), self.beam, np.zeros(0, np.int64)
        while len(waiting) and beam < count:
            hubs, known = self._found(narrow[waiting], beam) if known is None else known, None
            rows, late = np.repeat(waiting, beam), np.tile(np.arange(beam) >= beam // 4, len(waiting))
            hubs = hubs.ravel()
            new = (hubs >= 0) & ~np.isin(rows * count + hubs, before) if len(before) else hubs >= 0
            order = np.flatnonzero(new)[np.argsort(hubs[new], kind="stable")]
            rows, late, hubs = rows[order], late[order], hubs[order]
            full, cuts = np.zeros(len(q), bool), np.flatnonzero(np.diff(hubs)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hubs)], strict=True):
                own, hub = rows[begin:end], hubs[begin]
                for place, member in self._near(q, narrow, own, self.starts[hub], self.starts[hub + 1]):
                    other = note(own[place], member)
                    place = place[other]
                    full[own[place[late[begin:end][place]]]] = True
            # a beam that has links behind its first quarter may have missed some
            stay = full[rows]
            before = np.concatenate([before[full[before // count]], rows[stay] * count + hubs[stay]])
            waiting, beam = np.flatnonzero(full), 2 * beam
            if STEP_COST * LOWEST * beam >= len(self.ids):
                break
        for place, member in self._near(q, narrow, waiting, 0, len(self.ids)):
            row = waiting[place]
            new = ~np.isin(row * count + self.hub[member], before) if len(before) else np.ones(len(row), bool)
            note(row[new], member[new])
        linked = np.flatnonzero(first >= 0)
        yield from zip(ids[linked].tolist(), links[linked].tolist(), self.ids[first[linked]].tolist(), strict=True)

    def forest(self) -> Iterator[tuple[int, int, int]]:
        """Links among members that queries have joined, with the count of those that members have gained."""
        roots = self._roots(np.arange(len(self.parent)))
        told = np.flatnonzero((roots != np.arange(len(roots))) | (self.gained > 0))
        yield from zip(self.ids[told].tolist(), self.gained[told].tolist(), self.ids[roots[told]].tolist(), strict=True)


def _rows(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["id", "links", "other"])


def _answer_shards(threshold: float):
    """Rows of a shard arrive together: its members first, then the queries of other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, members = None, None, []

        def told(rows: Iterator[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
            while some := list(islice(rows, TOLD_ROWS)):
                yield _rows(some)

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if shard is None and members:
                parts = [np.concatenate(c) for c in zip(*members, strict=True)]
                members.clear()
                shard = Shard(*parts, threshold)
                yield from told(shard.own())

        def close() -> Iterator[pa.RecordBatch]:
            yield from built()
            if shard is not None:
                yield from told(shard.forest())

        let_go()
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("shard", "dim", "kind", "node", "copies")}
            shards, dims, kinds, nodes, copies = (c.to_numpy(zero_copy_only=False) for c in column.values())
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(dims) != 0) | (np.diff(kinds) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if (shards[start], dims[start]) != key:
                    yield from close()
                    key, shard, members = (shards[start], dims[start]), None, []
                vectors = part.column(part.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False).reshape(stop - start, -1)
                if kinds[start] == 0:
                    members.append((nodes[start:stop], vectors, copies[start:stop]))
                    continue
                yield from built()
                if shard is not None:  # else no member of this dimension is in the shard
                    yield from told(shard.answer(nodes[start:stop], _unit(vectors), copies[start:stop]))
        yield from close()

    return run


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and has finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Null or zero vectors, vectors with null or non-finite components and rows with a
    null id link with nothing. Vectors of different dimension do not link. Equal
    vectors are one node of the graph, so copies do not grow it. Nodes have numbers of
    their own: rows that share an id but not a vector are judged each for itself. An empty
    table gives an empty one; other columns are not read.
    """
    if threshold <= 0:
        raise ValueError("The threshold has to be positive.")
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    good = usable(F.col("vector")) & F.col("vec_id").isNotNull()
    # 128 bits of two hashes stand for a vector
    keyed = given.withColumns({"key": F.when(good, F.xxhash64("vector")), "twin": F.when(good, F.xxhash64(F.lit(1), "vector"))})
    equal = keyed.where("key is not null").groupBy("key", "twin")
    nodes = checkpointed(
        equal.agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.max(F.size("vector")).alias("dim")).withColumn("node", F.monotonically_increasing_id())
    )
    count, width = nodes.agg(F.count("*"), F.max("dim")).first()
    # vectors in both precisions, and links
    most = max(1, min(shard_rows, SHARD_BYTES // (12 * (width or 1) + 8 * LOWEST)))
    shards = max(shards, -(-count // most))
    own, step = F.pmod("key", F.lit(shards)).cast("int"), F.col("step")
    dealt = (
        equal.agg(F.any_value("vector").alias("vector"))
        .join(nodes, ["key", "twin"])
        # to the own shard as a member, and as a query to half of the others; the other half asks this one
        .select(own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards // 2))).alias("step"), "dim", "node", "copies", "vector")
        .where((2 * step < shards) | (2 * F.col("own") < shards))
        .select(F.pmod(F.col("own") + step, F.lit(shards)).alias("shard"), "dim", (step > 0).cast("int").alias("kind"), "node", "copies", "vector")
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "dim", "kind", "node")
    )
    found = checkpointed(dealt.mapInArrow(_answer_shards(threshold), "id long, links long, other long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "other")
    linked = checkpointed(
        nodes.join(links.withColumnRenamed("id", "node"), "node", "left")
        .join(components.select(F.col("id").alias("node"), F.col("component").alias("root")), "node", "left")
        .where("links > 0 or root is not null or copies > 1")  # other vectors stand alone
        .select(
            F.col("key").alias("own_key"),
            F.col("twin").alias("own_twin"),
            "low",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    per_node = linked.join(lowest, "root").select("own_key", "own_twin", "links", "component")
    component = F.coalesce("component", "vec_id")
    same = (F.col("key") == F.col("own_key")) & (F.col("twin") == F.col("own_twin"))
    return keyed.drop("vector").join(per_node, same, "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
