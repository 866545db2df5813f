"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from . import common


def components(links: DataFrame, rounds: int = 64, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that its links reach; stored.

    known has such rows for links found earlier: they come back too, brought up to date, and only links between its components are followed.

    Every step is a partial aggregation (minimum per node), written, and a join against it, so a node of very many links is never
    brought together in a task: its side of the join is a plain exchange that adaptive execution can split. The number of steps grows
    with the logarithm of the longest chain; they end once all links lead straight to a root. Each step is written to the shared
    folder. Null ends and self links say nothing."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if known is not None:
        for end in ("u", "v"):
            at = known.select(F.col("node").alias(end), "root")
            ends = ends.join(at, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    edges = common.stored(_clean(ends), "links")
    for _ in range(rounds + 1):
        n, unsettled = _state(edges)
        if not unsettled:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "links")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = common.stored(_clean(large), "links")
        least = common.stored(down.groupBy("u").agg(F.min("v").alias("m")), "links")
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = common.stored(_clean(small), "links")
    else:
        raise RuntimeError("links did not settle")
    if known is not None and not n:
        return known
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    if known is not None:
        roots = common.stored(roots, "roots")
        moved = known.join(roots.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = moved.union(roots.join(known.select("node"), "node", "left_anti"))
    return common.stored(roots, "roots")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many nodes the links have, and how many of these do not yet lead straight to a root: such as have two smaller
    neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("ways"))
    with storage.cleaning(edges.sparkSession):
        return tuple(seen.agg(F.count(F.lit(1)), F.count_if(F.col("ways") > 1)).first())
