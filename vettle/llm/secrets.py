"""Secret scans with corpus-wide ownership frequency.

Base detectors find assignments, access ids and long hexadecimal runs; a wide detector finds long tokens that look
random: letters and digits touch at four places or more, the characters' entropy is 3.2 bits or more, and the token is
no UUID. Paths, slugs and versions fail the first. Every candidate's value is hashed, and hashes are counted by distinct
repositories (a repository is a distinct text, unless a column is named, so copies of a text are one) and owners
(sources): values that several owners or more than `MOST_REPOSITORIES` repositories hold are copied examples, values of
one owner are live-looking. The wide candidates that look live are added to the base spans as kind `owned`. Built-in
functions only.

One pass reads the texts and writes a narrow table of spans; the counts are three map-side combined aggregations, so a
value that a third of all rows hold is a few rows a task; verdicts meet the spans by a shuffled join whose hot values
adaptive execution splits. Places come from prefix sums in a logarithm of steps, so a text with many matches takes time
little above its length.

Spans are code points, end exclusive, of the whole match. Defined cases: null text is empty and has no spans; texts are
read whole at any length; null owners count as one owner, null repositories as one; repeated rows are rows of their own
in the result but one repository in the counts; where spans tie in start, the kinds' order decides; an empty table gives
an empty result; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm.common import text_or_empty, written


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"""({'|'.join(map(any_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "(AKIA[A-Z0-9]{16,})"
HEX = "([0-9a-f]{24,})"
WIDE = "([A-Za-z0-9+/_-]{20,})"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Places where letter and digit touch, and bits a character, that a wide candidate has at least.
TOUCHING, ENTROPY = 4, 3.2
KINDS = ("assign", "access", "hex", "owned")
MOST_REPOSITORIES = 20


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(x: Column, combine) -> Column:
    """Each element of an array combined with all before it, in steps of 1, 2, 4, ..."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int"))
    before = lambda a, i, k: F.get(a, i - F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, x, lambda a, k: F.transform(a, lambda y, i: F.coalesce(combine(y, before(a, i, k)), y)))


def _spans(body: Column, pattern: str, kind: int, value: int, keep) -> Column:
    """Array of (start, kind, end, value) of the pattern's matches: lengths of what it matches and of what stands before, summed up."""
    parts = F.struct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(body, F.lit(pattern), F.lit(value)).alias("v"), F.split(body, pattern, -1).alias("p"))

    def placed(s: Column) -> Column:
        lengths = F.transform(s["m"], lambda m, i: F.length(m) + F.length(F.get(s["p"], i)))
        one = lambda e, i: F.struct((e - F.length(F.get(s["m"], i))).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), F.get(s["v"], i).alias("value"))
        return F.transform(let(lengths, lambda x: running(x, lambda a, b: a + b)), one)

    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return F.when(body.rlike(pattern), F.filter(let(parts, placed), keep)).otherwise(none)


def entropy(value: Column) -> Column:
    """Bits a character, from the characters' frequencies in the value."""
    share = lambda chars, c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return let(F.split(value, ""), lambda chars: F.aggregate(F.transform(F.array_distinct(chars), lambda c: let(share(chars, c), lambda p: -p * F.log2(p))), F.lit(0.0), lambda a, x: a + x))


def random_looking(value: Column) -> Column:
    touching = F.regexp_count(value, F.lit("[A-Za-z][0-9]")) + F.regexp_count(value, F.lit("[0-9][A-Za-z]"))
    return (touching >= TOUCHING) & ~value.rlike(UUID) & (entropy(value) >= ENTROPY)


def candidates(docs: DataFrame, text: str, repository: str | None, owner: str, key: str) -> DataFrame:
    """(row, doc_id, owner, repository, spans) of every row, written: one pass over the texts."""
    body = text_or_empty(text)
    df = docs.select(F.col(key).alias("doc_id"), F.col(owner).alias("owner"), (F.col(repository).cast("string") if repository else F.hex(F.xxhash64(body))).alias("repository"), body.alias("text"))
    anything = lambda s: F.lit(True)
    parts = [
        _spans(F.col("text"), ASSIGN, 0, 2, lambda s: F.length(s["value"]) >= 6),
        _spans(F.col("text"), ACCESS, 1, 1, anything),
        _spans(F.col("text"), HEX, 2, 1, anything),
        _spans(F.col("text"), WIDE, 3, 1, lambda s: random_looking(s["value"])),
    ]
    df = df.select("doc_id", "owner", "repository", F.array_sort(F.concat(*parts)).alias("spans"))
    df = df.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash"))))
    return written(df.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) over the corpus."""
    seen = found.select("repository", "owner", F.explode("spans.hash").alias("hash")).groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def clear_of_base(spans: Column) -> Column:
    """`spans`, by start, without wide ones that overlap a base span: none before ends later, none after begins earlier."""
    far = F.lit(2**31 - 1)
    base = lambda s: s["kind"] < 3
    ends = let(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(F.lit(0))), lambda x: running(x, F.greatest))
    starts = let(F.reverse(F.transform(spans, lambda s: F.when(base(s), s["start"]).otherwise(far))), lambda x: F.reverse(running(x, F.least)))
    clear = lambda s, i, b: base(s) | (s["live"] & (F.get(b["ends"], i) <= s["start"]) & (F.get(b["starts"], i) >= s["end"]))
    return let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda b: F.filter(spans, lambda s, i: clear(s, i, b)))


def joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, text: str = "text", repository: str | None = None, owner: str = "source", most_repositories: int = MOST_REPOSITORIES, key: str = "doc_id") -> DataFrame:
    """One row for each row of `docs`: doc_id, owner, spans (start, kind, end, hash, n_repositories, n_owners, live).

    `spans` holds all base spans and the wide ones that look live and overlap no base span; `kind` indexes KINDS.
    """
    found = candidates(docs, text, repository, owner, key)
    some = found.filter("size(spans) > 0")
    counts = written(ownership(some), "owners")  # a plain side, so that adaptive execution can split a hot value's rows
    rows = some.select("row", "doc_id", "owner", F.explode("spans").alias("s"))
    met = rows.withColumn("hash", F.col("s.hash")).join(counts, "hash")
    live = (F.col("n_owners") == 1) & (F.col("n_repositories") <= most_repositories)
    span = F.struct("s.start", "s.kind", "s.end", "hash", "n_repositories", "n_owners", live.alias("live"))
    spans = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("owner").alias("owner"), F.array_sort(F.collect_list(span)).alias("spans"))
    spans = spans.select("doc_id", "owner", clear_of_base(F.col("spans")).alias("spans"))
    kind = spans.schema["spans"].dataType.simpleString()
    return spans.unionByName(found.filter("size(spans) = 0").select("doc_id", "owner", F.array().cast(kind).alias("spans")))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of `secret_scan`."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
