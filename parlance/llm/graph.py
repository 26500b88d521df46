"""Connected components over an edge table by alternating large and small stars; nothing is collected but a checksum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def _state(edge: DataFrame) -> tuple[int, int | None]:
    """Number and checksum of the edges."""
    return tuple(edge.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the smallest node reachable; roots are left out.

    Each round ends in a table in the shared folder, so a lost executor costs one round at most; rounds go on until the
    edges stay as they are. Hubs are met by aggregates with map-side partial results and by broadcasts of bounded size.
    Every step is cut as well: a round in one plan would hold the first step's joins ten times over, in the driver's memory.
    """
    edge = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edge = cut(edge, "edges")
    seen = _state(edge)
    while True:
        total = seen[0]
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = cut(join_hot(both, least, ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_hot(large, lowest, ["u"], "n", 2 * total)
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edge = cut(small, "edges")
        now = _state(edge)
        if now == seen:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
