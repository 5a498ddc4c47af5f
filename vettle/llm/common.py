"""What the training-data operators share: words, shared tables, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettle.sources.tables import plain_unions, written  # noqa: F401  the operators take it from here

#: ASCII white space and what stands between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows that a side may have to be broadcast by `sized_join`.
BROADCAST_ROWS = 20_000


def sized_join(big: DataFrame, small: DataFrame, on: Column, how: str = "inner", most: int | None = None) -> DataFrame:
    """`big` joined with `small`, which is broadcast only where a count shows `most` (BROADCAST_ROWS) rows at most: rows
    of a source, host or partition with a few numbers, some megabytes in all.

    Beyond, it is a shuffled join whose hot keys adaptive execution splits. `small` should be cheap to count:
    a written table or what stands on one.
    """
    most = BROADCAST_ROWS if most is None else most
    few = small.limit(most + 1).count() <= most
    return big.join(F.broadcast(small) if few else small, on, how)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """Working column names that clash with none of `df`, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, {}
    for n in names:
        x = f"_{n}"
        while x.lower() in taken:
            x = f"_{x}"
        taken.add(x.lower())
        out[n] = x
    return out
