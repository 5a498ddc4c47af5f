"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to budgets, whole epochs first.

Each document's key is an exponential variate of rate `weight`, drawn from a hash of doc_id. The weight is the chance
that the document is good, 0.05 at least, learned from a table of labels (doc_id, quality 1 or 0): naive Bayes over four
binned figures of the text (share of symbols, characters a word, number of words, share of distinct words), with one
added to each count. Without labels all weigh alike. Every labelled document counts; the model is a table of under 70 rows.

Within a source, documents are taken in key order until the fraction of an epoch that the target leaves is filled. The
sorted prefix sum never gathers a source: sizes are summed into 4,096 ranges of the key, the range that holds the cut is
found from those sums and is cut into 4,096 again, three times in all; what shares the last range is sorted. Sources are
numbered over range partitions, and the level that caps leave is found by repeated sums, so neither is gathered into
one task. Built-in functions only.

Defined cases: a null source is a source of its own and comes last; null or empty text has size 0, and takes part with
taken 0; texts are read whole at any length; documents that repeat source, key and doc_id are taken together or not at
all, whichever comes nearer the target; ties in the key go to the least doc_id; an empty table gives an empty result;
extra columns pass through `mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettle.llm.common import WORD, fresh, sized_join, text_or_empty, written
from vettle.operators.rank import numbered

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Bits of the key's place, and of one step of ranges.
BITS, STEP = 36, 12
LEAST_WEIGHT, BINS = 0.05, 17
FIGURES = ("symbols", "length", "size", "distinct")


def figures(text: str) -> dict[str, Column]:
    """The words of a text, counted, and its binned figures."""
    body = text_or_empty(text)
    words = F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1))
    size, n = F.size(words), F.length(body)
    some = F.greatest(size, F.lit(1))
    symbols = F.regexp_count(body, F.lit("[#*$%&|<>]"))
    return {
        "size": size.cast("long"),
        "f_symbols": F.when(symbols == 0, 0).when(100 * symbols < n, 1).when(20 * symbols < n, 2).otherwise(3),
        "f_length": F.least(F.lit(15), F.floor(n / some)).cast("int"),
        "f_size": F.least(F.lit(16), F.length(F.bin(size.cast("long")))),
        "f_distinct": F.floor(10 * F.size(F.array_distinct(words)) / some).cast("int"),
    }


def quality_model(narrow: DataFrame, labels: DataFrame | None) -> dict[tuple[str, int], float]:
    """Log odds of good for each figure's bin, and of the prior, ("", 0). `narrow`: doc_id and the binned figures, `labels`: doc_id, quality."""
    if labels is None:
        return {}
    known = narrow.join(labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("l"), "quality"), F.col("doc_id") == F.col("l"))
    each = known.select("quality", F.explode(F.array(*(F.struct(F.lit(f).alias("figure"), F.col(f"f_{f}").alias("bin")) for f in FIGURES), F.struct(F.lit("").alias("figure"), F.lit(0).alias("bin")))).alias("x"))
    rows = each.groupBy("x.figure", "x.bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()  # a row for each bin
    total = next(((r.good, r.bad) for r in rows if r.figure == ""), (0, 0))
    spark = narrow.sparkSession
    odds = {("", 0): f"ln(double({total[0] + 1}) / double({total[1] + 1}))"}
    seen = {(r.figure, r.bin): (r.good, r.bad) for r in rows}
    for f in FIGURES:
        for b in range(BINS):
            good, bad = seen.get((f, b), (0, 0))
            odds[f, b] = f"ln(double({good + 1}) / double({total[0] + BINS})) - ln(double({bad + 1}) / double({total[1] + BINS}))"
    got = spark.range(1).select(*(F.expr(x) for x in odds.values())).first()
    return dict(zip(odds, got))


def weight(model: dict[tuple[str, int], float], columns: dict[str, Column]) -> Column:
    """Chance that a text is good."""
    if not model:
        return F.lit(1.0)
    total = F.lit(model["", 0])
    for f in FIGURES:
        total = total + F.element_at(F.array(*(F.lit(model[f, b]) for b in range(BINS))), columns[f"f_{f}"] + 1)
    return F.greatest(F.lit(LEAST_WEIGHT), 1.0 / (1.0 + F.exp(-total)))


def es_key(doc_id: Column, weight_: Column, seed: str) -> Column:
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return -F.log((u + 0.5) / float(2**52)) / weight_


def place(draw: Column) -> Column:
    """The key as a whole number of BITS bits, in the same order."""
    return F.floor(draw / (1 + draw) * float(2**BITS)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target).

    A level L gives each source the lesser of L times its weight and its cap: from no source capped, those over their
    cap at the level are capped and the level of the rest is found anew, until none is over.
    """
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    t = written(numbered(totals, [F.col("source").asc_nulls_last()], "rank").select("source", "source_size", cycle.alias("w"), (most * F.col("source_size")).alias("cap")), "mix-sources")
    all_ = t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, level = -1, 0.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        n, caps, rest = t.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~over, F.col("w")))).first()
        if n == capped or rest is None:
            break
        capped, level = n, (share * all_ - caps) / rest
    return t.select("source", "source_size", (F.col("cap") if rest is None else F.least("cap", F.lit(level) * F.col("w"))).alias("target"))


def same_source(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(draws: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """For each source: s, source_size, target, epochs, left, cut_place (null: none) and last, the key and doc_id that the fraction takes last.

    `draws`: a written table (doc_id, source, size, draw, place).
    """
    shift = BITS - STEP
    range_ = lambda by: F.shiftright("place", by)
    sums = written(draws.groupBy("source", range_(shift).alias("range")).agg(F.sum("size").alias("size")), "mix-ranges")
    t = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = written(t.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets").withColumnRenamed("source", "s")
    at = t.select("s", "left", F.lit(0).cast("long").alias("base"))
    while True:
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("range"))
        met = sized_join(sums, at, same_source("source", "s")).withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size"))
        cuts = met.filter("before <= left and upto > left").groupBy("s").agg(F.min(F.struct("range", "before", "left")).alias("cut"))
        cuts = written(cuts.select("s", F.col("cut")["range"].alias("cut_range"), F.col("cut")["before"].alias("base"), F.col("cut")["left"].alias("left")), "mix-cuts")
        inside = sized_join(draws, cuts, same_source("source", "s") & (range_(shift) == F.col("cut_range")))
        if shift == 0:
            break
        shift -= STEP
        sums = written(inside.groupBy("source", range_(shift).alias("range")).agg(F.sum("size").alias("size")), "mix-ranges")
        at = cuts.select("s", "left", "base")
    peers = inside.groupBy("s", "draw", "doc_id", "base", "left").agg(F.sum("size").alias("size"))
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("s").orderBy("draw", "doc_id"))
    last = peers.withColumn("upto", upto).filter("upto - size / 2 <= left").groupBy("s").agg(F.max(F.struct("draw", "doc_id")).alias("last"))
    for side in (cuts.select(F.col("s").alias("c"), F.col("cut_range").alias("cut_place")), last.withColumnRenamed("s", "c")):
        t = t.join(side, same_source("s", "c"), "left").drop("c")
    return written(t, "mix-plan")


def copies(place_: Column, draw: Column, doc_id: Column, p: dict[str, str] | None = None) -> Column:
    """How often a document is taken, beside its source's row of `plan` (under the names in `p`)."""
    c = lambda n: F.col(p[n] if p else n)
    whole = c("cut_place").isNull() & (c("left") > 0)
    at_cut = (place_ == c("cut_place")) & c("last").isNotNull() & (F.struct(draw.alias("draw"), doc_id.alias("doc_id")) <= c("last"))
    return c("epochs") + F.coalesce(whole | (place_ < c("cut_place")) | at_cut, F.lit(False)).cast("long")


def drawn(rows: DataFrame, model: dict, key: str, seed: str, name: dict[str, str]) -> Column:
    """The E-S key of each of `rows`, which have the figures under the names in `name`."""
    return es_key(F.col(key), weight(model, {f"f_{f}": F.col(name[f"f_{f}"]) for f in FIGURES}), seed)


def draws_of(rows: DataFrame, labels: DataFrame | None, key: str, source: str, seed: str, name: dict[str, str]) -> tuple[DataFrame, dict]:
    """((doc_id, source, size, draw, place), written, the quality model) of written rows with figures; no text is read."""
    model = quality_model(rows.select(F.col(key).alias("doc_id"), *(F.col(name[f"f_{f}"]).alias(f"f_{f}") for f in FIGURES)), labels)
    narrow = rows.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(name["size"]).alias("size"), drawn(rows, model, key, seed, name).alias("draw"))
    return written(narrow.withColumn("place", place(F.col("draw"))), "mix-draws"), model


def mix_table(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document; no text is kept."""
    counted = figures(text)
    rows = written(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), *(c.alias(n) for n, c in counted.items())), "mix-figures")
    draws, _ = draws_of(rows, labels, "doc_id", "source", seed, {n: n for n in counted})
    met = sized_join(draws, plan(draws, **how), same_source("source", "s"), "left")
    return met.select("doc_id", "source", "size", "source_size", "target", copies(F.col("place"), F.col("draw"), F.col("doc_id")).alias("copies"))


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix", **how) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken. Texts are written once with their figures, and never shuffled."""
    counted = figures(text)
    name = fresh(docs, *counted, "draw", "copy")
    rows = written(docs.withColumns({name[n]: c for n, c in counted.items()}), "mix-rows")
    draws, model = draws_of(rows, labels, key, source, seed, name)
    p = plan(draws, **how)
    clash = fresh(rows, *p.columns)
    rows = rows.withColumn(name["draw"], drawn(rows, model, key, seed, name))
    met = sized_join(rows, p.select(*(F.col(c).alias(clash[c]) for c in p.columns)), same_source(source, clash["s"]))
    taken = copies(place(F.col(name["draw"])), F.col(name["draw"]), F.col(key), clash)
    return met.withColumn(name["copy"], F.explode(F.array_repeat(F.lit(1), taken.cast("int")))).select(*docs.columns)
