"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenwright.llm.common import checkpointed


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of them.

    The table of minima is written out, so that both sides of the join are plain
    shuffles and a node with very many links can be split at run time.
    """
    minima = checkpointed(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = edges.join(minima, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        minima.select("u", F.col("m").alias("v"))
    )


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every id with a link; the component is its smallest id.

    Links are undirected; self links, repeated links and links with a null end are
    ignored. No component is gathered anywhere: each round is two aggregates and two
    joins over the links, and rounds grow with the logarithm of the component sizes.
    """
    high = F.greatest(F.col(a), F.col(b))
    low = F.least(F.col(a), F.col(b))
    given = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = checkpointed(_clean(given.select(high.alias("u"), low.alias("v"))))
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = checkpointed(_clean(_star(both, larger_only=True)))
        edges = checkpointed(_clean(_star(large, larger_only=False)))
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
