"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettle.llm.common import written


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """(id, component) of each id of `links` (a, b): component is the smallest id that can be reached.

    Alternating large-star and small-star rounds: every node hangs its greater neighbours, then its lesser ones, on
    the least of them, until all hang on their component's least node. A round is two map-side combined minima, written,
    and two joins with them whose hot nodes adaptive execution splits; the table never grows. Rounds are about the
    logarithm of the size.
    """

    def state(df: DataFrame) -> tuple:
        """Changes with the rows: their number and a combined hash."""
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())

    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least")).withColumn("least", F.least("n", "least"))
        least = written(least, tag)
        # large star: (greater neighbour, least)
        large = both.filter("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = written(large, tag)
        # small star: a node's lesser neighbours and itself hang on the least
        lesser = written(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least")), tag)
        met = large.join(lesser, F.col("u") == F.col("n"))
        small = met.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(lesser.select(F.col("n").alias("u"), F.col("least").alias("v"))).distinct()
        new = written(small, tag)
        edges, now = new, state(new)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
