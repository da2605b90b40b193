"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townwire.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is its smallest reachable node.

    Every round is written to the scratch folder, so a lost executor repeats one round at
    most. Neighbours are never gathered: a round only takes minima and joins them back.
    Rounds grow with the logarithm of a component's size.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    n = e.count()
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")))).alias("x"))
        new = stored(small.select("x.*").filter("a < b").distinct(), "edges")
        n_before, n = n, new.count()
        if n == n_before and new.join(e, ["a", "b"], "left_anti").isEmpty():  # no row is new
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", F.col("a"))).distinct()
        e = new
