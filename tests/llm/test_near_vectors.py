"""Vectors that share an id, large groups of near vectors, and recall against brute force on shards of some thousands."""

from __future__ import annotations

import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from screenwright.llm import near_vectors
from screenwright.llm.near_vectors import Shard, link_vectors

KIND = "vec_id long, embedding array<double>"


def brute(ids, x, threshold=0.9):
    """Links, component and kept of each row; rows, not ids, are linked."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    component = np.arange(len(x))
    while True:
        low = np.array([min(component[i], component[near[i]].min(initial=component[i])) for i in range(len(x))])
        if (low == component).all():
            break
        component = low
    smallest = defaultdict(lambda: 1 << 60)
    for i, c in zip(ids, component, strict=True):
        smallest[c] = min(smallest[c], i)
    return sorted((i, int(n), smallest[c], smallest[c] == i) for i, n, c in zip(ids, near.sum(axis=1), component, strict=True))


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    for rows in ([(1, [1, 0, 0]), (1, [0, 1, 0]), (2, [1, 0.01, 0])], [(1, [1, 0, 0]), (1, [1, 0.01, 0])]):
        frame = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], KIND)
        want = brute([i for i, _ in rows], np.array([x for _, x in rows], float))
        assert sorted(map(tuple, link_vectors(frame).collect())) == want
    base = rng.normal(size=(30, 6))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.2, 0.4)] + [base[:5]])
    ids = rng.integers(0, 25, size=len(x)).tolist()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], KIND)
    assert sorted(map(tuple, link_vectors(frame).collect())) == brute(ids, x)


def test_a_large_group_of_near_vectors_and_the_recall_of_a_large_shard():
    rng = np.random.default_rng(6)
    near = rng.normal(size=32) + rng.normal(size=(2000, 32)) * 0.1
    small = np.repeat(rng.normal(size=(150, 32)), 4, axis=0)
    x = np.concatenate([near, small + rng.normal(size=small.shape) * 0.2, rng.normal(size=(1400, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    begun = time.time()
    shard = Shard(np.arange(len(x)), x, np.ones(len(x), int), 0.9)
    built = time.time()
    found = {i: (n, other) for i, n, other in shard.answer(np.arange(len(x)), x)}
    assert time.time() - built < 60 and built - begun < 120
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    links = true.sum(axis=1)
    got = np.array([found.get(i, (0, 0))[0] for i in range(len(x))])
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum() and (got > 0)[links > 0].mean() >= 0.98
    assert (got[:2000] == links[:2000]).mean() >= 0.98


def test_each_two_shards_meet_once(spark, monkeypatch):
    """A vector goes to its own shard and to half of the others; of each two vectors one asks the other."""
    rng = np.random.default_rng(7)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], KIND)
    tables, write = [], near_vectors.checkpointed

    def dealt_rows(threshold):
        def run(batches):
            for batch in batches:
                shard, kind, node = (batch.column(batch.schema.get_field_index(c)).cast(pa.int64()) for c in ("shard", "kind", "node"))
                yield pa.RecordBatch.from_arrays([node, kind, shard], ["id", "links", "other"])

        return run

    monkeypatch.setattr(near_vectors, "_answer_shards", dealt_rows)
    monkeypatch.setattr(near_vectors, "checkpointed", lambda df: tables.append(write(df)) or tables[-1])
    for shards in (1, 2, 5, 8):
        tables.clear()
        link_vectors(frame, shards=shards)
        rows = next(t for t in tables if t.columns == ["id", "links", "other"]).collect()
        own = {r["id"]: r["other"] for r in rows if r["links"] == 0}
        asked = Counter((own[r["id"]], r["other"]) for r in rows if r["links"])
        sizes = Counter(own.values())
        assert len(own) == 200 and len(rows) <= 200 * (1 + shards / 2)
        assert all(n == sizes[a] for (a, b), n in asked.items())
        assert sorted(tuple(sorted(p)) for p in asked) == [(a, b) for a in range(shards) for b in range(a + 1, shards)]


def test_both_ends_of_a_link_between_shards_are_counted(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.1, base[:20] + rng.normal(size=(20, 8)) * 0.3, base[:9], base[:4]])
    ids = rng.permutation(len(x)).tolist()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], KIND)
    want = brute(ids, x)
    for shards in (1, 2, 3):
        assert sorted(map(tuple, link_vectors(frame, shards=shards).collect())) == want


def test_a_shard_stays_small_and_finds_links_of_other_shards():
    """Memory of a shard's graph and audit, and recall where the beam covers a part of the hubs only."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40_000, 16)).astype(np.float32)
    near = x[:8000] + rng.normal(size=(8000, 16)).astype(np.float32) * 0.3
    tracemalloc.start()
    begun = time.time()
    shard = Shard(np.arange(len(x)), x, np.full(len(x), 2), 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and time.time() - begun < 60
    assert shard.beam < len(shard.starts) - 1
    q = near / np.linalg.norm(near.astype(float), axis=1, keepdims=True)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = np.concatenate([q[k : k + 1000] @ unit.T >= 0.9 for k in range(0, len(q), 1000)])
    found = {i: (n, other) for i, n, other in shard.answer(np.arange(len(x), len(x) + len(q)), q, np.full(len(q), 3))}
    got = np.array([found.get(len(x) + i, (0, 0))[0] for i in range(len(q))])
    assert (got <= 2 * true.sum(axis=1)).all() and got.sum() >= 0.98 * 2 * true.sum()
    assert all(true[i - len(x), other] for i, (_, other) in found.items())
    gained = {i: n for i, n, _ in shard.forest() if n}
    assert sum(gained.values()) * 2 == got.sum() * 3 and set(gained) <= set(np.flatnonzero(true.any(axis=0)).tolist())


def test_members_of_a_shard_find_each_other_from_their_first_beams():
    rng = np.random.default_rng(10)
    base = rng.normal(size=(4000, 16))
    x = np.concatenate([base, base[:2000] + rng.normal(size=(2000, 16)) * 0.3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = Shard(np.arange(len(x)), x, np.ones(len(x), int), 0.9)
    assert shard.beam < len(shard.starts) - 1
    true = x @ x.T >= 0.9
    np.fill_diagonal(true, False)
    found = {i: (n, other) for i, n, other in shard.own()}
    got = np.array([found.get(i, (0, 0))[0] for i in range(len(x))])
    assert (got <= true.sum(axis=1)).all() and got.sum() >= 0.98 * true.sum() > 2000
    assert all(true[i, other] for i, (_, other) in found.items())
    # the members' links make the same groups as all found links, and none is counted twice
    assert not any(n for _, n, _ in shard.forest())
