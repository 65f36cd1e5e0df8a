"""Connected components of a link table, without any driver-side or single-task collection of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, comp for every node that a link names; comp is the smallest node reachable from it.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until the links no longer change. A round
    aggregates the neighbours of a node to their minimum before the shuffle and joins it back, so a hub costs a skewed
    join, which adaptive execution splits, and never a collected list. Each round's links are written to the shared
    folder, which cuts the lineage. Links with a null end and links of a node with itself count for nothing; without
    links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole")).where("whole AND u != v").drop("whole").distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        state, before = _state(edges), state
        if state == before:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
