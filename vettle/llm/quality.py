"""Quality rules with host verdicts.

Each document's rule failures are summed by host (any column: here the source). A host's failure rate of a rule is
shrunk towards the corpus by a beta prior fitted to the hosts by moments (hosts weighed by their documents, chance
variation taken off), and a host for which the rate less its posterior deviation, for any rule,
passes `max_rate` (three documents in ten) fails with all its documents. The fewer documents a host has, and the more
alike the hosts are, the nearer its rate is to the corpus's; a corpus of like hosts has no failing one. Built-in functions only; texts never shuffle: features are written as
a narrow table, aggregated by host with map-side sums, and met with the few host rows again.

Defined cases: null or empty text has no words and fails; texts are read whole at any length; a null host is a host of
its own; repeated rows count as often as they stand there; a rate that ties with `max_rate` passes; an empty table gives
an empty result; extra columns pass through `quality_filter`, whatever they are called. Windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm.common import SPACE, WORD, fresh, sized_join, text_or_empty, written

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE = 8, 20, 30, 0.3
#: Beside the base verdict, these fail a document towards its host's rates; alone they drop nothing.
RULES = {
    "base": "base_failed",
    "symbols": "10 * n_symbols > word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}


def repeat_words(words: str, k: int = WINDOW) -> Column:
    """Words of the array column `words` that lie in a k-word window found twice or more."""
    return F.expr(
        f"""case when size({words}) < {k + 1} then 0L else
        element_at(transform(array(transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k})))), h ->
          case when size(array_distinct(h)) = size(h) then 0L else
          element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x as x, i as i)))), s ->
            element_at(transform(array(sort_array(transform(filter(s, (e, j) -> e.x = get(s, j - 1).x or e.x = get(s, j + 1).x), e -> e.i))), p ->
              aggregate(p, struct(0L as n, -{k} as at), (a, i) -> struct(a.n + least({k}, i - a.at) as n, i as at), a -> a.n)), 1)), 1) end), 1) end"""
    )


def features(docs: DataFrame, text: str, out: dict[str, str]) -> DataFrame:
    """`docs` with the base figures under the names in `out`."""
    body = text_or_empty(text)
    w, l = out["words"], out["lines"]
    df = docs.withColumns({w: F.regexp_extract_all(body, F.lit(f"({WORD})")), l: F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))})
    df = df.withColumns(
        {
            out["n_words"]: F.size(w).cast("long"),
            out["word_chars"]: F.length(F.regexp_replace(body, f"{SPACE}+", "")).cast("long"),
            out["n_symbols"]: F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            out["n_lines"]: F.size(l).cast("long"),
            out["n_dup_lines"]: (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            out["n_repeat_words"]: repeat_words(w),
        }
    ).drop(w, l)
    return df.withColumn(out["base_failed"], (F.col(out["n_words"]) < MIN_WORDS) | (100 * F.col(out["n_repeat_words"]) > MAX_REPEAT_PERCENT * F.col(out["n_words"])))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed")


def strength(m: Column, ff: Column, n: Column, nn: Column, hosts: Column) -> Column:
    """The prior's strength, by the share of variation between hosts: 1 at least, 10^6 where hosts are alike.

    m: rate over all, ff: sum over hosts of f^2 / docs, n: of docs, nn: of docs^2.
    """
    between = ((ff - m * m * n) / F.nullif(m * (1 - m), F.lit(0.0)) - (hosts - 1)) / F.nullif(n - nn / n - (hosts - 1), F.lit(0.0))
    return F.when((m > 0) & (m < 1) & (hosts > 1) & (between > 0), F.least(F.lit(1e6), F.greatest(F.lit(1.0), 1 / between - 1))).otherwise(F.lit(1e6))


def host_verdicts(feats: DataFrame, host: str, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, rate_<rule> ..., host_failed) with shrunk rates."""
    by = feats.groupBy(host).agg(F.count("*").alias("n_docs"), *(F.sum(F.expr(x).cast("long")).alias(f"f_{k}") for k, x in RULES.items()))
    by = written(by, "host-sums")
    docs = F.col("n_docs").cast("double")
    sums = by.agg(F.count("*").alias("hosts"), F.sum(docs).alias("n"), F.sum(docs * docs).alias("nn"), *(F.struct((F.sum(f"f_{k}") / F.sum(docs)).alias("m"), F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / docs).alias("ff")).alias(k) for k in RULES))
    prior = sums.select(*(F.col(k)["m"].alias(f"m_{k}") for k in RULES), *(strength(F.col(k)["m"], F.col(k)["ff"], F.col("n"), F.col("nn"), F.col("hosts")).alias(f"s_{k}") for k in RULES))
    met = by.crossJoin(F.broadcast(prior))  # one row
    met = met.withColumns({f"rate_{k}": (F.col(f"f_{k}") + F.col(f"m_{k}") * F.col(f"s_{k}")) / (docs + F.col(f"s_{k}")) for k in RULES})
    failed, rates = F.lit(False), [f"rate_{k}" for k in RULES]
    for k in RULES:
        rate = F.col(f"rate_{k}")
        failed = failed | (rate - F.sqrt(rate * (1 - rate) / (docs + F.col(f"s_{k}") + 1)) > max_rate)
    return met.select(F.col(host).alias("host"), "n_docs", *rates, failed.alias("host_failed"))


def quality_table(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, host, the figures, host_failed and kept for every document; no text is kept."""
    name = {k: f"_f_{k}" for k in (*FIGURES, "words", "lines")}
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    feats = written(features(narrow, "text", name).select("doc_id", "host", *(F.col(name[k]).alias(k) for k in FIGURES)), "quality")
    hosts = host_verdicts(feats, "host", max_rate).withColumnRenamed("host", "h")
    met = sized_join(feats, written(hosts, "hosts"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
    return met.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of `docs` that pass their own base rules and whose host passes."""
    name = fresh(docs, *FIGURES, "words", "lines", "host")
    rows = written(features(docs, text, name).select(*docs.columns, *(name[k] for k in FIGURES)), "quality-rows")
    plain = rows.select(F.col(host).alias("host"), *(F.col(name[k]).alias(k) for k in FIGURES))
    bad = written(host_verdicts(plain, "host", max_rate).filter("host_failed").select(F.col("host").alias(name["host"])), "bad-hosts")
    return sized_join(rows.filter(~F.col(name["base_failed"])), bad, F.col(host).eqNullSafe(F.col(name["host"])), "left_anti").select(*docs.columns)
