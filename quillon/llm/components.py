"""Distributed connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm.common import discard, join_hot, materialize


#: Bytes of an edge; some 250,000 edges go to a file.
EDGE_BYTES = 64


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b), a table of their own, by alternating large and small stars.

    Each round hooks every node to the smallest neighbour it knows; minima are partial aggregates, and
    the join that hands them back leaves the edges of hubs where they are. Every round is written to the
    shared folder, so lost executors cost one round at most. The rounds end once the edges are stars.
    Self-loops, nulls and repeated edges are ignored; an empty table gives an empty result. component is
    the smallest node reachable.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), edges.count(), EDGE_BYTES
    )
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        n = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # one row for each edge at most, so repeated ones can wait for the end of the round
        large = _with_least(both, F.least(F.min("v"), F.first("u")), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = _with_least(large, F.min("v"), 2 * n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(small.where("u <> v").distinct(), 2 * n, EDGE_BYTES)
        discard(now)
        now = new
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _with_least(edges: DataFrame, least: Column, rows: int) -> DataFrame:
    """edges (u, v) with m, the least of each u; a hub's edges stay where they are if there may be hubs at all."""
    low = edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("_n"))
    if rows <= common.HOT_ROWS:
        return edges.join(low.drop("_n"), "u")
    low = materialize(low, rows, EDGE_BYTES)
    return join_hot(edges, low.drop("_n"), ["u"], low.where(F.col("_n") > common.HOT_ROWS))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v alone and no v is a u: as u > v, each v is then the smallest of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.where("up > 1 or (up = 1 and least = 0)").isEmpty()
