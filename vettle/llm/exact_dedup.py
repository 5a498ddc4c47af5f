"""Exact dedup: two passes over a Bloom filter of text hashes; only hashes that may repeat are grouped.

One pass over the texts writes a narrow row for each: key, hash of the text as it stands, SHA-256 of the normalised
text, length. Nothing after it carries a text.

Pass one counts how often each filter position is hit and keeps those hit twice or more, as written bitmaps of 32,768
bits. Pass two tests each narrow row against its bitmap: one that misses a position has no equal and is kept as it is;
the others are grouped by SHA-256, which decides. The filter has `bits_per_row` bits for each row, so its rate of false
alarms (about 1.5 % at 16 bits and two probes) is the same at every size, and no size changes the plan: bitmaps and
narrow rows meet by a join on the bucket, which adaptive execution turns into a broadcast where it sees few bytes.

`exact_dedup` gives whole rows: texts meet only the narrow table of rows that go, by an anti-join. Built-in functions
only.

Defined cases: null counts as empty text; texts of any length are one row, hashed whole; equal rows that repeat a doc_id
are one document and are marked alike (`exact_dedup` keeps one of them); of equal texts that tie in length, the least
doc_id stays, a null doc_id first; an empty table gives an empty result; extra columns pass through `exact_dedup`, also
where they bear a name used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm.common import fresh, written

BITS = 32_768
#: Deleted before texts are compared.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normal(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for s in SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def _probes(h: Column, n: int) -> list[Column]:
    again = F.xxhash64(h)
    return [F.shiftrightunsigned(again, 15 * i).bitwiseAND(F.lit(BITS - 1).cast("long")) for i in range(n)]


def repeated_positions(hashes: DataFrame, buckets: int, probes: int = 2) -> DataFrame:
    """(bucket, bits): the positions that two or more rows hit, from a table with a column `h`."""
    return (
        hashes.select(F.pmod("h", F.lit(buckets)).alias("bucket"), F.explode(F.array(*_probes(F.col("h"), probes))).alias("at"))
        .groupBy("bucket", "at")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bits"))
    )


def _hit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.element_at(F.array(*(F.getbit(byte, F.lit(i)) for i in range(8))), (at % 8).cast("int") + 1) == 1


def hashed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, raw, sha, len, h) of each row, written: one pass over the texts. `raw` is a hash of the text as it stands."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("raw"),
        F.unhex(F.sha2(normal(F.col(text)), 256)).alias("sha"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("len"),
    )
    return written(rows.withColumn("h", F.xxhash64("sha")), "text-hashes")


def maybe_repeated(rows: DataFrame, bits_per_row: int, probes: int) -> tuple[DataFrame, DataFrame]:
    """`rows` (with h) that have no equal, and those that may have one."""
    n = rows.count()
    buckets = max(1, -(-n * bits_per_row // BITS))
    bitmaps = written(repeated_positions(rows.select("h"), buckets, probes), "hash-bitmaps").select(F.col("bucket").alias("b"), "bits")
    met = rows.withColumn("bucket", F.pmod("h", F.lit(buckets))).join(bitmaps, F.col("bucket") == F.col("b"), "left")
    maybe = F.col("bits").isNotNull()
    for at in _probes(F.col("h"), probes):
        maybe = maybe & _hit(F.col("bits"), at)
    tested = written(met.select(*rows.columns, F.coalesce(maybe, F.lit(False)).alias("maybe")), "tested-hashes")
    return tested.filter("not maybe").drop("maybe"), tested.filter("maybe").drop("maybe")


def copies_table(docs: DataFrame, text: str = "text", key: str = "doc_id", bits_per_row: int = 16, probes: int = 2) -> DataFrame:
    """(id, sha, keep_id, group_size, kept, raw, keep_raw) of every row of `docs`."""
    alone, some = maybe_repeated(hashed(docs, text, key), bits_per_row, probes)
    groups = some.groupBy(F.col("sha").alias("k")).agg(F.min(F.struct((-F.col("len")).alias("len"), "id", "raw")).alias("best"), F.count("*").alias("group_size"))
    groups = written(groups, "copies")  # a plain side, so that adaptive execution can split a hot text's rows
    best = F.col("best")
    kept = F.col("id").eqNullSafe(best["id"]) & (F.col("len") == -best["len"])
    met = some.join(groups, F.col("sha") == F.col("k")).select("id", "sha", best["id"].alias("keep_id"), "group_size", kept.alias("kept"), "raw", best["raw"].alias("keep_raw"))
    one = F.lit(1).cast("long")
    return alone.select("id", "sha", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "raw", F.col("raw").alias("keep_raw")).unionByName(met)


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that stay, one for each distinct normalised text, with the columns of `docs`.

    Rows that repeat text and doc_id are one document: any one of them stays. Rows that share a doc_id but not their
    text are told apart by the text's hash.
    """
    groups = copies_table(docs, text, key, **how).filter("group_size > 1")
    chosen = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    gone = groups.filter(~chosen).select("id", "raw").distinct()
    several = written(groups.filter(chosen).groupBy("id", "raw").agg(F.count("*").alias("n")).filter("n > 1").select("id", "raw"), "repeated-rows")
    name = fresh(docs, "id", "raw", "hash")
    on = F.col(key).eqNullSafe(F.col(name["id"])) & (F.col(name["hash"]) == F.col(name["raw"]))
    rows = docs.withColumn(name["hash"], F.xxhash64(text))
    meets = lambda t, how: rows.join(t.select(F.col("id").alias(name["id"]), F.col("raw").alias(name["raw"])), on, how)
    out = meets(written(gone.unionByName(several), "rows-that-go"), "left_anti").select(*docs.columns)
    if several.isEmpty():
        return out
    return out.unionByName(meets(several, "left_semi").dropDuplicates([key, name["hash"]]).select(*docs.columns))
