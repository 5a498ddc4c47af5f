"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the last return the columns of
documents. The driver of the pipeline writes each stage's result and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettle.llm import exact_dedup, langid, mixing, near_dedup, packing
from vettle.llm.common import documents, fresh, written
from vettle.llm.queries import vocabulary


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those predicted `und` go."""
    name = fresh(docs, "lang_pred", "score", "ambiguous")
    df = langid.identified(docs, langid.train(docs), names=tuple(name.values()))
    return df.filter(F.col(name["lang_pred"]) != langid.UNKNOWN).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.exact_dedup(docs)


#: Least similarity in percent of near duplicates; the query op8 has its own contract.
NEAR_PERCENT = 80


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id."""
    name = fresh(docs, "gone")["gone"]
    comps = near_dedup.near_components(docs, percent=NEAR_PERCENT)
    gone = written(comps.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; weights are learned from the table of labels."""
    return mixing.mix_sources(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1,024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("language ID", language_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Language prediction and token ids can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for step, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{step.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
