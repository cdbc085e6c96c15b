"""Distributed connected components: alternating large-star and small-star rounds over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, itself included; kept, so that the join after it can split hot nodes."""
    return keep(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(src, dst) of any one orderable type -> (node, component): the smallest node reachable.

    Nodes without an edge to another node don't appear. Nulls link nothing. Repeated edges and loops do no harm.
    Every round is partial aggregation and equi joins, whose hot nodes Spark's skew join splits; nothing but two
    numbers a round reaches the driver.
    """
    now = keep(
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(),
        "edges",
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        large = keep(
            both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        joined = large.join(_lowest(large), "u")
        out = joined.select(F.explode(F.array(F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = keep(out.select("e.hi", "e.lo").where("hi > lo").distinct(), "edges")
        was, seen = seen, _state(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())
