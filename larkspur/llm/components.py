"""Connected components of an edge table by repeated contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _order(col):
    return F.struct(F.xxhash64(col).alias("h"), col.alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` longs -> ``(id, component)``: every vertex with an edge, and the smallest id it can reach.

    Each round maps a vertex to the least of its closed neighbourhood (in hashed order, so that long
    chains shrink by a constant share), then joins the maps into the edges and drops loops. The rounds grow
    with the logarithm of the longest chain. Every round is written to the shared folder, so both sides of its joins are
    shuffled from files and Spark can split the rows of a hub.
    """
    e = materialise(
        edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(),
        "cc-edges",
    )
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionByName(e.select(F.col("dst").alias("v"), F.col("src").alias("w")))
        step = both.groupBy("v").agg(F.min(_order(F.col("w"))).alias("m"))
        step = materialise(step.select("v", F.least(F.col("m"), _order(F.col("v")))["v"].alias("root")), "cc-map")
        maps.append(step)
        e = e.join(step.withColumnsRenamed({"v": "src", "root": "a"}), "src").join(step.withColumnsRenamed({"v": "dst", "root": "b"}), "dst")
        e = materialise(e.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "cc-edges")
    if not maps:
        return e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    found = maps[-1]
    for step in reversed(maps[:-1]):
        up = found.select(F.col("v").alias("root"), F.col("root").alias("top"))
        found = materialise(step.join(up, "root", "left").select("v", F.coalesce("top", "root").alias("root")), "cc-map")
    least = found.groupBy("root").agg(F.least(F.min("v"), F.col("root")).alias("component"))
    return found.join(materialise(least, "cc-least"), "root").select(F.col("v").alias("id"), "component")
