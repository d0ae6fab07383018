"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) for every id that some link names; links hold no nulls.

    Each step moves links towards smaller ids and is written once to the shared folder; the links and their number
    stay distributed.  Ends when a step changes nothing: every id then points to its component's smallest one.
    """
    edges = cut(links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v > u").distinct(), "links")
    before = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        # large star: larger neighbours of v move to the smallest id that v knows
        large = both.join(low, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its smaller neighbours move to the smallest of these
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = cut(moved.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    """Number of links and a checksum of them all."""
    hashed = F.xxhash64("v", "u")
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(hashed, F.lit(2**31 - 1))).alias("h")).first()
    return row.n, row.h
