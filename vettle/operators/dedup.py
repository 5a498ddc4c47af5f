"""First-wins dedup by content or e-mail, and a Bloom filter as a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.sources.tables import written


def dedup_by_hash(docs: DataFrame, key: str = "file_ord", hash_: str = "h") -> DataFrame:
    """`docs` with the least key of its hash: a map-side combined minimum, met by a join that splits hot hashes."""
    first = written(docs.groupBy(F.col(hash_).alias("_h")).agg(F.min(key).alias("first")), "first-of-hash")
    return docs.join(first, F.col(hash_).eqNullSafe(F.col("_h"))).drop("_h")


def first_wins(docs: DataFrame) -> DataFrame:
    """(file_ord, kept, duplicate_of) from (file_ord, h, e): greedy in the order of file_ord, losers register no key.

    Rounds on the narrow table: an undecided row that is the least of all its keys is kept; rows that share a key with a
    kept one are duplicates. Each round decides the least undecided row at least; few rounds are usual. A row's first
    holder is found afterwards, hash before e-mail. Each round is written, which cuts lineage and survives lost executors.
    """
    # one row for each pair of keys can be kept, the first; the rest of such a pair are its duplicates
    pairs = docs.select("file_ord", "h", F.nullif(F.lower("e"), F.lit("")).alias("e"))
    open_ = written(pairs.groupBy("h", "e").agg(F.min("file_ord").alias("file_ord")), "undecided")
    kept = None
    while not open_.isEmpty():
        mh = open_.groupBy(F.col("h").alias("_h")).agg(F.min("file_ord").alias("mh"))
        me = open_.filter("e is not null").groupBy(F.col("e").alias("_e")).agg(F.min("file_ord").alias("me"))
        met = open_.join(mh, F.col("h").eqNullSafe(F.col("_h"))).join(me, F.col("e") == F.col("_e"), "left")
        new = written(met.filter((F.col("file_ord") == F.col("mh")) & (F.col("me").isNull() | (F.col("file_ord") == F.col("me")))).select("file_ord", "h", "e"), "kept")
        kept = new if kept is None else kept.unionByName(new)
        left = open_.join(new.select(F.col("h").alias("_h")).distinct(), F.col("h").eqNullSafe(F.col("_h")), "left_anti")
        left = left.join(new.filter("e is not null").select(F.col("e").alias("_e")).distinct(), F.col("e") == F.col("_e"), "left_anti")
        open_ = written(left, "undecided")
    if kept is None:
        return pairs.select("file_ord", F.lit(True).alias("kept"), F.col("file_ord").alias("duplicate_of"))
    by_h = kept.select(F.col("h").alias("_h"), F.col("file_ord").alias("kh"))
    by_e = kept.filter("e is not null").select(F.col("e").alias("_e"), F.col("file_ord").alias("ke"))
    met = pairs.join(by_h, F.col("h").eqNullSafe(F.col("_h")), "left").join(by_e, F.col("e") == F.col("_e"), "left")
    own = (F.coalesce("kh", F.lit(-1)) == F.col("file_ord")) | (F.coalesce("ke", F.lit(-1)) == F.col("file_ord"))
    holder = F.when(F.col("kh") < F.col("file_ord"), F.col("kh")).when(F.col("ke") < F.col("file_ord"), F.col("ke"))
    return met.select("file_ord", own.alias("kept"), F.when(~own, holder).alias("duplicate_of"))


def bloom_size(capacity: int, fp_rate: float) -> tuple[int, int]:
    """(bits, hash functions)."""
    m = max(8, int(-capacity * math.log(fp_rate) / math.log(2) ** 2))
    return m, max(1, round(m / capacity * math.log(2)))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """Double hashing: k positions of the item among m bits, from two parts of its digest."""
    part = lambda i: F.conv(F.substring(F.md5(item.cast("string")), i, 15), 16, 10).cast("long")
    h1, h2 = F.pmod(part(1), F.lit(m).cast("long")), F.pmod(part(17).bitwiseOR(F.lit(1).cast("long")), F.lit(m).cast("long"))
    return F.array(*(F.pmod(h1 + i * h2, F.lit(m).cast("long")) for i in range(k)))


def bloom_filter(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """(bucket, bits): the filter as bitmaps of 32,768 bits."""
    at = items.select(F.explode(bloom_positions(F.col(column), m, k)).alias("at"))
    return at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def bloom_contains(items: DataFrame, column: str, filter_: DataFrame, m: int, k: int, key: str) -> DataFrame:
    """(key, maybe): whether all positions of each item are set."""
    at = items.select(key, F.explode(bloom_positions(F.col(column), m, k)).alias("at")).withColumn("bucket", F.bitmap_bucket_number("at"))
    met = at.join(filter_, "bucket", "left")
    bit = F.bitmap_bit_position("at")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.element_at(F.array(*(F.getbit(byte, F.lit(i)) for i in range(8))), (bit % 8).cast("int") + 1) == 1, F.lit(False))
    return met.groupBy(key).agg(F.bool_and(hit).alias("maybe"))


def distinct_lookups(requests: DataFrame, key: str) -> DataFrame:
    """One row for each key that is asked for, with how many asked: a loader runs once for each."""
    return requests.groupBy(key).agg(F.count("*").alias("waiting"))


def first_seen(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first): the value of the least order."""
    return df.groupBy(key).agg(F.min_by(value, order).alias("first"))
