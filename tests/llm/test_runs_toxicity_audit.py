"""The operators on words and filters against brute force, and the toxic span model on held-out texts."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenwright.llm import filter_audit, periodic_runs, toxicity
from screenwright.llm.filter_audit import audit_filters, distinct_words, measure_documents
from screenwright.llm.periodic_runs import find_runs, runs_of
from screenwright.llm.toxicity import SpanModel, learn_toxicity, marginals, pair_marginals, score_toxicity

DOCS = "doc_id long, text string, source string, n int"


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, 7)
        words = [w if i < a else words[min(a + (i - a) % p, n - 1)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_several_texts_side_by_side(least):
    rng = random.Random(least)
    for _ in range(200):
        texts = [periodic(rng, rng.randint(0, 60), range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))]
        lengths = np.array([len(t) for t in texts])
        start, stop, period = runs_of(np.array([w for t in texts for w in t], np.int64), lengths[lengths > 0], least)
        want, before = [], 0
        for t in texts:
            want += [(before + s, before + s + n, q) for s, n, q in plain_runs(t, least)]
            before += len(t)
        assert list(zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_long_hostile_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 1000)
    start, stop, period = runs_of(np.zeros(30_000, np.int64), np.array([30_000]))
    assert (start.tolist(), stop.tolist(), period.tolist()) == ([0], [30_000], [1])
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    start, stop, period = runs_of(np.array(b), np.array([len(b)]), 2)
    assert [(s, e - s, q) for s, e, q in zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)] == plain_runs(b, 2)


def test_find_runs_on_odd_rows(spark):
    rng = random.Random(1)
    texts = [" \t".join(periodic(rng, rng.randint(0, 80), ["a", "é", "a b", "B"])) for _ in range(40)]
    texts += [None, "", " \n\x0b", "x " * 40, "x " * 40, " ".join("xx") + " y" * 30]
    rows = [(i if i % 7 else None, t, "s", i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("RUNS", F.lit(1)).withColumn("Collapsed", F.lit(2))
    found = find_runs(frame)
    assert found.columns == ["doc_id", "text", "source", "n", "runs", "collapsed"]
    for r in found.collect():
        words = [w.decode() for w in (texts[r["n"]] or "").encode().split()]
        want = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == sorted(want, key=lambda x: (x[0], x[2]))
        assert r["collapsed"] == plain_collapsed(words, want)
    assert find_runs(frame.limit(0)).count() == 0


def test_marginals_against_all_labellings(monkeypatch):
    monkeypatch.setattr(toxicity, "LINK", 3)
    rng = np.random.default_rng(4)
    for _ in range(20):
        lengths = rng.integers(1, 9, size=4)
        evidence, tie = rng.normal(size=lengths.sum()) * 2, np.exp(rng.normal(size=(2, 2)))
        found, ahead, behind = marginals(evidence, lengths, tie)
        pairs, before = pair_marginals(ahead, behind, lengths, tie), 0
        for n in lengths.tolist():
            one, two, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(evidence[before : before + n] @ np.array(y)) * np.prod([tie[a, b] for a, b in itertools.pairwise(y)])
                total, one = total + w, one + w * np.array(y)
                for i, (a, b) in enumerate(itertools.pairwise(y)):
                    two[i, a, b] += w
            assert np.allclose(found[before : before + n], one / total) and np.allclose(pairs[before : before + n], two / total)
            before += n


def toxic_rows(rng, n):
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    rows = []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([40, 150, 400]))]
        toxic = int(i % 4 == 0)
        for _ in range(len(words) // 30 + 2 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vokk", "Zwurm", "xigxig" + rng.choice(syllables)]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = toxic_rows(random.Random(7), 400)
    odd = [(1000, None), (1001, ""), (1002, "123 !?"), (None, "vokk vokk vokk Zwurm"), (1003, "vokk Zwurm " * 4 + "lala " * 100_000)]
    given = [(i, t, "s", 0) for i, t, _ in rows] + [(i, t, "s", 1) for i, t in odd]
    frame = spark.createDataFrame(given, DOCS).withColumn("SCORE", F.lit("x")).withColumn("Spans", F.lit("y"))
    # an id with both labels, labels that are none, and labels of ids without rows are passed over
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = learn_toxicity(frame, labels)
    scored = score_toxicity(frame, model)
    assert scored.columns == ["doc_id", "text", "source", "n", "score", "predicted", "spans"]
    found = {(r["doc_id"], r["n"]): r for r in scored.collect()}
    assert len(found) == len(given) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found.values())
    held = [r["doc_id"] for r in frame.where(~toxicity.learnable(F.col("doc_id"), toxicity.FOLDS, toxicity.HELD_OUT)).collect() if r["doc_id"] is not None and r["n"] == 0]
    right = sum(found[i, 0]["predicted"] == rows[i][2] for i in held)
    assert len(held) > 90 and right >= 0.95 * len(held)
    assert all(found[i, 1]["predicted"] == 0 and found[i, 1]["spans"] == [] for i in (1000, 1001, 1002))
    assert found[None, 1]["predicted"] == 1
    for r in found.values():
        for x in r["spans"]:
            assert any(w in r["text"][x["start"] : x["end"]] for w in ("vokk", "Zwurm", "xig")) or r["n"] == 0
    assert found[1003, 1]["spans"][0]["start"] == 0
    assert score_toxicity(frame.limit(0), model).count() == 0
    alone = learn_toxicity(frame, labels.limit(0))
    assert alone is None and {r["score"] for r in score_toxicity(frame, alone).collect()} == {0.5}
    assert SpanModel.fit(["a", "b"], [1, 1]) is None and SpanModel.fit(["1", ""], [0, 1]) is None


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    text = b"b aa b c aa b\n"
    want = ([b"aa", b"b", b"c"], [1, 0, 1, 2, 0, 1])
    for inverse in (filter_audit.INVERSE, 0):  # with 0 all hashes are equal
        monkeypatch.setattr(filter_audit, "INVERSE", inverse)
        words, which, begin = distinct_words(text)
        assert sorted(words) == want[0] and [words[i] for i in which] == [want[0][i] for i in want[1]]
        assert begin.tolist() == [0, 2, 5, 7, 9, 12]
    assert distinct_words(b"\n \n")[0] == []


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = t.encode().split()
        failed = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > low[t],
        }
        docs.append((part or "", "".join(k for k in "ABCDE" if failed[k]), i in good, i in toxic))
    out, removed_by = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                here, before = [d for d in left if f in d[1]], len([d for d in docs if d[0] == part and f in d[1]])
                left = [d for d in left if f not in d[1]]
                alone = sum(d[1] == f and d[0] == part for d in docs)
                removed_by[part, f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), before - len(here), alone, sum(d[2] for d in here), sum(d[3] for d in here)]
    return {k: tuple([*v, removed_by[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def audit_rows(rng):
    rows = []
    for i in range(120):
        words = [rng.choice(["a", "Bc", "dé", "x#", "漢", "word"]) + str(rng.randrange(rng.choice([3, 400]))) for _ in range(rng.choice([0, 10, 49, 50, 80]))]
        rows.append((rng.choice([i, i, None, 5]), rng.choice([" ", "\n", "\x0c"]).join(words), rng.choice(["s1", "s2", "", None])))
    rows += [(rng.randrange(200), rows[3][1], "s1") for _ in range(60)] + [(300, None, "s3"), (301, "", "s3"), (7, " " * 9, "s2")]
    return rows


@pytest.mark.parametrize("shard", [1, 32 << 20])
def test_audit_against_all_orders(spark, monkeypatch, shard):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", shard)
    rows = audit_rows(random.Random(9))
    labels = [(i, i % 2, i % 3 % 2) for i in range(150)] + [(4, 1, None), (4, 0, 0), (None, 1, 1), (3, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit(1)).withColumn("WORDS", F.lit("x"))
    found = audit_filters(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = found.collect()
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in got} == plain_audit(rows, labels) and len(got) == 600 * 4
    assert audit_filters(frame.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_word_numbers_are_equal_in_all_shards(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 1)
    rows = audit_rows(random.Random(10))
    frame = spark.createDataFrame([(n, t, str(n)) for n, (_, t, _) in enumerate(rows)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in measure_documents(frame, f"{tmp_path}/shards").collect()}
    for n, (_, t, _) in enumerate(rows):
        words = (t or "").encode().split()
        assert (found[n]["words"], found[n]["distinct_words"]) == (len(words), len(set(words)))
        assert bytes(found[n]["digest"]) == hashlib.sha256((t or "").encode()).digest()
