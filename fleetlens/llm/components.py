"""Distributed connected components: alternating large-star / small-star.

Each round points every node at the smallest neighbour it can see, first
for its larger neighbours, then for its smaller ones, until every edge
leads to the smallest node of its component. DataFrame operations only.
A hub's edges are spread over ``SALTS`` slices, and each slice gets its
own copy of the hub's minimum, so no task holds all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize

SALTS = 16


def _with_min(edges: DataFrame) -> DataFrame:
    """Add ``m``, the smallest ``v`` of each ``u``, to rows (u, v)."""
    s = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = s.groupBy("u", "_s").agg(F.min("v").alias("_pm"))
    # at most SALTS rows per u in this window
    full = part.select("u", "_s", F.min("_pm").over(W.partitionBy("u")).alias("m"))
    return s.join(full, ["u", "_s"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_with_min(both).where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    r = _with_min(edges)
    # r is used once: each row yields its neighbour's edge and its own
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return (r.select(F.explode(pairs).alias("e")).select("e.u", "e.v")
            .where(F.col("u") != F.col("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node on an edge between two different nodes.

    ``component`` is the smallest node reachable. Null ends and self loops
    are ignored; repeated edges count once; an empty table gives no rows.
    The driver reads back one count and checksum a round.
    """
    e = (edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
         .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = materialize(e, "components")
    seen = _state(e)
    while seen[0]:
        e = materialize(_small_star(_large_star(e)), "components")
        now = _state(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
