"""Queries of the screening engine and their SQL."""

from pyspark.sql import DataFrame, SparkSession

from vettle.queries import folds, screening
from vettle.queries.oracles import ORACLES  # noqa: F401

QUERIES = screening.QUERIES | folds.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked report."""
    return screening.win_rank(spark, sf_dir)
