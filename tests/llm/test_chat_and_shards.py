"""Long conversations, exact draws, and more partitions than the matrix has rows."""

from __future__ import annotations

import random
import time
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from screenwright.llm import sharding
from screenwright.llm.chat_format import format_chats, read_loss, read_turns


def chat(spark, n):
    turns = spark.range(0, n, 1, 1).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 > 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    out = format_chats(turns).select("formatted", "loss_spans")
    begun = time.time()
    row = out.select(F.size(read_turns(F.col("formatted"))).alias("n"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert row.n == n and row.loss == "".join(f"t{i}" for i in range(0, n, 3))
    return time.time() - begun


def test_time_of_a_long_conversation_grows_with_its_turns(spark):
    chat(spark, 1000)
    half, whole = (min(chat(spark, n) for _ in range(2)) for n in (20_000, 40_000))
    assert whole < 20 and whole < 2.3 * half + 1


def test_draws_follow_their_law_at_any_size():
    rng = random.Random(3)
    for good, bad, drawn in ((5, 7, 6), (1, 30, 4), (40, 2, 20)):
        found = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(6000))
        for k in range(max(0, drawn - bad), min(good, drawn) + 1):
            p = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)
            assert abs(found[k] / 6000 - p) < 5 * (p * (1 - p) / 6000) ** 0.5 + 1e-3
    big = 10**12
    values = [sharding.hypergeometric(rng, big // 24, big - big // 24, 10**6) for _ in range(2000)]
    mean, deviation = 10**6 / 24, (10**6 / 24 * 23 / 24) ** 0.5
    assert abs(sum(values) / 2000 - mean) < 5 * deviation / 2000**0.5
    spread = (sum((v - mean) ** 2 for v in values) / 2000) ** 0.5
    assert spread == pytest.approx(deviation, rel=0.1)
    rows = sharding.communication_matrix([rng.randrange(2000) for _ in range(20_000)], 24, 5)
    sizes = [sum(row[s] for row in rows) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_more_partitions_than_the_matrix_takes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_CELLS", 20)
    table = spark.range(900).withColumn("SLOT", F.lit("x")).repartition(12)
    out = sharding.shuffle_into_shards(table, 5).collect()
    assert sorted(r.id for r in out) == list(range(900))
    assert Counter(r.shard for r in out) == dict.fromkeys(range(5), 180)
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(180)) for s in range(5))
