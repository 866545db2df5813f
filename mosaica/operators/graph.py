"""Graph traversal over an edge table (src, kind, dst) of record ids ``table:key``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored

EDGES = "src string, kind string, dst string"


def step(front: DataFrame, edges: DataFrame, way: str, name: str, kinds: set[str]) -> DataFrame:
    """One hop of (row, node). A name that is no kind of edge keeps the nodes of the table so named."""
    if name != "*" and name not in kinds:
        return front.where(F.substring_index("node", ":", 1) == name)
    some = edges if name == "*" else edges.where(F.col("kind") == name)
    out = some.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    back = some.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    links = {"->": out, "<-": back, "<->": out.union(back)}[way]
    return front.join(links, "node").select("row", F.col("to").alias("node"))


def hops(starts: DataFrame, edges: DataFrame, steps: tuple[tuple[str, str], ...], kinds: set[str]) -> DataFrame:
    """(row, nodes) from starts (row, node): the nodes that the steps reach, as often as they do."""
    front = starts
    for way, name in steps:
        front = step(front, edges, way, name, kinds)
    return front.groupBy("row").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def _grown(edges: DataFrame, start: str, goal: str, kind: str, most: int) -> DataFrame | None:
    """Breadth-first search along out-edges; (node, path) of the goal, or None. Each frontier is written, visited nodes stay out
    of the next; the driver sees counts alone."""
    spark = edges.sparkSession
    some = edges if kind == "*" else edges.where(F.col("kind") == kind)
    links = some.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    front = spark.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path"))
    seen = front.select("node")
    for _ in range(most + 1):
        hit = front.where(F.col("node") == goal).limit(1)
        if hit.take(1):
            return hit
        grown = front.join(links, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.array_append("path", F.col("to"))).alias("path"))
        front = stored(grown.join(seen, "node", "left_anti"), "frontier")
        if not front.take(1):
            return None
        seen = seen.union(front.select("node"))
    hit = front.where(F.col("node") == goal).limit(1)
    return hit if hit.take(1) else None


def connected(edges: DataFrame, start: str, goal: str, kind: str = "*", most: int = 10) -> bool:
    """Whether goal is reached from start in at most ``most`` + 1 hops."""
    return start == goal or _grown(edges, start, goal, kind, most) is not None


def path(edges: DataFrame, start: str, goal: str, kind: str = "*", most: int = 10) -> list[str]:
    """A shortest path of at most ``most`` hops as record ids, the smallest of these; empty if there is none."""
    if start == goal:
        return [start]
    found = _grown(edges, start, goal, kind, most - 1) if most > 0 else None
    return list(found.first()["path"]) if found is not None else []
