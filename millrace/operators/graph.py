"""Connected components over an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges (first two columns); component is the smallest node.

    Nulls and loops are ignored. Each round links every node to the smallest member of its neighbourhood,
    which halves distances, and cuts the lineage; the loop ends when no edge changes, and
    raises an error if that takes more than ``rounds``, where they are given. Nothing but the count of changed
    edges reaches the driver.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for n in itertools.count():
        if n == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            e = new
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct()
