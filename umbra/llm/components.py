"""Connected components by alternating large and small stars, DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.common import discard, materialise

#: Rounds needed grow with the square of the logarithm of the longest chain; this is never reached in practice.
MAX_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that isn't its component's smallest.

    ``edges`` has u and v of one orderable type; loops and nulls are ignored.
    A node with very many neighbours is folded by map-side minima, and the join
    that hands the minimum back is one that adaptive execution can split. Each
    round is written to the shared folder, so a lost executor costs one round;
    a round's files go when the next one is written.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, mark = _held(edges)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        was, before = mark, edges
        edges, mark = _held(_small_star(_large_star(edges)))
        discard(before)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _held(edges: DataFrame) -> tuple[DataFrame, tuple]:
    held = materialise(edges, "edges")
    row = held.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(hash(v, u))").alias("y")).first()
    return held, tuple(row)
