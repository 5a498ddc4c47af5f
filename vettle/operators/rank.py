"""Global order without gathering rows: range partitions, places within them, prefix-summed totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettle.sources.tables import tasks, written

_LOCAL = 33  # bits of monotonically_increasing_id that count rows within a partition


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its 1-based place in `order`, which must be a total order for the places to be defined."""
    placed = df.repartitionByRange(tasks(df.sparkSession, df.count()), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ordered").withColumn("_part", F.shiftright("_at", _LOCAL))
    totals = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select(F.col("_part").alias("_p"), before.alias("_before"))  # a row for each partition
    met = placed.join(F.broadcast(bases), F.col("_part") == F.col("_p"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _LOCAL) - 1)) + 1
    return met.withColumn(name, place).drop("_at", "_part", "_p", "_before")


def ranked(df: DataFrame) -> DataFrame:
    """Rank by total, AI depth, similarity, name; file_ord makes ties stable."""
    order = [F.desc("total_score"), F.desc("ai_project_depth"), F.desc(F.coalesce("jd_similarity", F.lit(0.0))), F.asc("candidate_name"), F.asc("file_ord")]
    return numbered(df, order, "rank")


def top(df: DataFrame, n: int) -> DataFrame:
    """The n best rows, by a top-n that never sorts the whole."""
    return df.orderBy(F.desc("total_score"), F.desc("ai_project_depth"), F.desc(F.coalesce("jd_similarity", F.lit(0.0))), "candidate_name", "file_ord").limit(n)
