"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every partition's rows are permuted locally. How many of them go to each shard is drawn
beforehand, exactly as a uniform shuffle of all rows would have it: row by row of the
partition-by-shard matrix from the multivariate hypergeometric distribution, so that
all margins are met. After the exchange each shard is permuted again. All row work is
DataFrame expressions; plain arithmetic on the driver draws the matrix from the counts.
"""

from __future__ import annotations

import json
import random
from math import sqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed, free_names

#: Most cells (partitions x shards) of a matrix; beyond it neighbouring partitions are taken together as one.
MOST_CELLS = 4_000_000
#: Rows of a shard that are numbered in one task, about.
ROWS_PER_SLICE = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement, are good.

    Inversion over weights relative to the mode's, divided by their sum, so no digits are lost in factorials. Weights
    beyond twelve standard deviations are smaller than a random number can tell.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = sqrt(drawn * (good / total) * (bad / total) * (max(total - drawn, 1) / max(total - 1, 1)))
    reach = int(12 * spread) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    logs = np.append(0.0, np.cumsum(steps))
    sums = np.cumsum(np.exp(logs - logs[mode - first]))
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), last - first)


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition (row) sends to each shard (column); shard sizes differ by one at most."""
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        row, need, left = [], count, sum(room)
        for s in range(shards):
            left -= room[s]
            take = hypergeometric(rng, room[s], left, need)
            row.append(take)
            need -= take
            room[s] -= take
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """All columns of ``rows``, plus ``shard`` (from 0) and ``slot`` (from 0, gapless in a shard).

    Shard sizes differ by one row at most and every assignment is equally likely. Null
    values, empty texts, ties and repeated rows are rows like any other; equal rows
    cannot be told apart and may change places. An empty table gives an empty one.
    Columns named ``shard`` or ``slot`` are replaced. Any number of partitions will do: where there are more than
    ``MOST_CELLS`` allows, several are read by one task, without a shuffle. The keys that decide are written
    to the checkpoint folder, so a task that is run again decides the same.
    """
    if shards < 1:
        raise ValueError("The number of shards has to be positive.")
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rows = rows.select(*columns)
    at, key, cuts, cell, base = free_names(rows, "at_", "key_", "cuts_", "cell_", "base_")
    # local permutation: the random key is a digest of the row and of its place
    placed = checkpointed(
        rows.coalesce(max(1, MOST_CELLS // shards)).withColumn(key, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
        .sortWithinPartitions(key)
        .withColumn(at, F.monotonically_increasing_id())
    )
    partition, rank = F.shiftright(F.col(at), 33).cast("int"), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], shards, seed)
    table = []
    for p, row in zip(order, matrix, strict=True):
        ends, end = [], 0
        for n in row:
            end += n
            ends.append(end)
        table.append({"p": p, "ends": ends})
    spark = rows.sparkSession
    text = json.dumps(table)
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<p:int,ends:array<bigint>>>"))).toDF("p", cuts)
    sent = (
        placed.join(F.broadcast(ends), partition == F.col("p"))
        .withColumn("shard", F.size(F.filter(F.col(cuts), lambda e: e <= rank)))
        .drop("p", cuts)
    )
    # second permutation: number a shard in slices of the key's range, then add up the slices before
    slices = max(1, sum(sizes.values()) // shards // ROWS_PER_SLICE + 1)
    again = F.xxhash64(F.lit(seed + 1), F.col(at))
    sent = sent.withColumn(key, again).withColumn(cell, F.pmod(F.shiftright(F.col(key), 1), F.lit(slices)))
    counts = sent.groupBy("shard", cell).agg(F.count("*").alias(base)).orderBy("shard", cell).collect()
    before, start = {}, {}
    for r in counts:
        before[(r["shard"], r[cell])] = start.get(r["shard"], 0)
        start[r["shard"]] = start.get(r["shard"], 0) + r[base]
    text = json.dumps([{"s": s, "c": c, "b": b} for (s, c), b in before.items()])
    bases = spark.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<s:int,c:bigint,b:bigint>>")))
    number = F.row_number().over(Window.partitionBy("shard", cell).orderBy(key, at))
    numbered = sent.withColumn("slot", number.cast("long") - 1)
    out = numbered.join(F.broadcast(bases), (F.col("s") == F.col("shard")) & (F.col("c") == F.col(cell)))
    return out.select(*columns, "shard", (F.col("slot") + F.col("b")).alias("slot"))
