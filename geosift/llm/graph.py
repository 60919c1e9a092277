"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geosift.llm.common import stage


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """u -> m: the smallest of u and its neighbours; edges (u, v) in both directions."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked with the smallest vertex around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_min_neighbour(both), "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_min_neighbour(down), "u")
    pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is its component's smallest id."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges (a, b) of comparable ids -> id, comp: the smallest id reachable, for every id that has an edge.

    Every step is a pre-aggregated minimum and a join on its key: no neighbourhood is ever gathered. The
    number of rounds grows with the logarithm of the longest chain; stars need none. An empty edge table
    gives no rows.
    """
    down = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stage(down, "cc")
    while not _is_stars(now):
        now = stage(_small_star(_large_star(now)), "cc")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()
