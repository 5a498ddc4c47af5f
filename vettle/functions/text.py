"""Text scalars of the screening engine as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from vettle import lexicon as L
from vettle.sources.tables import written



def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(DoubleType())
def _py_round1(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else round(x, 1))


NOT_ASCII = r"[^\x00-\x7F]"


def nfkc(c: Column) -> Column:
    """NFKC, by Python; `by_ascii` spares texts that it leaves alone the way there."""
    return _nfkc(c)


def by_ascii(df: DataFrame, column: str, f) -> DataFrame:
    """`df` with f(column) where `column` has more than ASCII; other rows stay in the JVM, a branch of their own."""
    odd = F.coalesce(F.col(column).rlike(NOT_ASCII), F.lit(False))
    return df.filter(~odd).unionByName(df.filter(odd).withColumn(column, f(F.col(column))))


def normalized_rows(df: DataFrame, column: str) -> DataFrame:
    """`df` with its text column normalised."""
    # what is read from files can't be read twice at no cost
    rows = written(df, "read")
    return by_ascii(rows, column, nfkc).withColumn(column, normalized(F.col(column), unicode_form=False))


def title(c: Column) -> Column:
    """Each run of letters with case begins with a capital and goes on in small letters."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(f"[{cased}]+|[^{cased}]+"), F.lit(0)), F.initcap), "")


def py_round1(c: Column) -> Column:
    """Rounded to one place, half to even on the exact binary value."""
    return _py_round1(c)


def drop_controls(c: Column) -> Column:
    """Without private-use, control and format characters but for line feed and tab."""
    return F.regexp_replace(c, r"[\p{Co}\p{Cc}\p{Cf}&&[^\n\t]]", "")


def bullets(c: Column) -> Column:
    return F.translate(c, L.BULLETS, "•" * len(L.BULLETS))


def spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\x{A0}]+", " ")


def dehyphen(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def blank_lines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalized(c: Column, unicode_form: bool = True) -> Column:
    return blank_lines(dehyphen(spaces(bullets(drop_controls(nfkc(c) if unicode_form else c)))))


def folded(c: Column) -> Column:
    """Small letters, also for the four letters beyond ASCII that a pattern without case takes for ASCII ones."""
    return F.lower(F.translate(c, "\u017f\u212a\u0131\u0130", "skii"))


def maybe(small: Column, pattern: str) -> Column:
    """Whether a folded text has a literal that any match of the pattern needs: a plain search that spares most patterns."""
    return reduce(lambda a, b: a | b, (F.contains(small, F.lit(x)) for x in L.needed(pattern))) if L.needed(pattern) else F.lit(True)


def has(text: Column, small: Column, pattern: str) -> Column:
    """Whether `text`, of which `small` is the folded form, matches the pattern."""
    return maybe(small, pattern) & text.rlike(L.java(pattern))


def with_small(text: Column, f) -> Column:
    """f(text, its folded form), each computed once."""
    return let(text, lambda t: let(folded(t), lambda small: f(t, small)))


def clean(c: Column) -> Column:
    return with_small(c, lambda t, small: F.when(maybe(small, L.NOISE), F.regexp_replace(t, L.java(L.NOISE), " ")).otherwise(t))


def fingerprint(c: Column) -> Column:
    return F.sha2(alnum(c), 256)


def content_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def email(text: Column, links: Column | None = None) -> Column:
    found = F.nullif(F.regexp_replace(F.regexp_extract(text, L.java(L.EMAIL, case=True), 0), r"\.+$", ""), F.lit(""))
    if links is None:
        return found
    mail = F.get(F.filter(links, lambda x: x.startswith("mailto:")), F.lit(0))
    return F.coalesce(found, F.substring(mail, F.lit(8), F.length(mail)))


def trim_ellipsis(c: Column, n: int = 220) -> Column:
    one = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(rstrip(F.substring(one, 1, n - 1)), F.lit("…")))


def clean_title(c: Column) -> Column:
    # fixed value: what looks like a date at a title's end
    dates = r"(?Ud)\s*\(?\b(?:\d{1,2}/)?(?:19|20)\d{2}\b.*$|\s+\d{1,2}/\S*.*$|\s+[A-Z][a-z]{2,8}\.? ?(?:19|20)\d{2}.*$"
    t = F.regexp_replace(F.regexp_replace(c, dates, ""), r"(?Ud)\s+(?:GitHub|Live Link|Demo)\b.*$", "")
    t = F.regexp_replace(F.get(F.split(t, r"\|", -1), F.lit(0)), "^[ \\-—–|]+|[ \\-—–|]+$", "")
    return F.coalesce(F.nullif(trim_ellipsis(t, 80), F.lit("")), F.lit("Project"))


def name_of(text: Column, mail: Column, file: Column) -> Column:
    """The first of eight lines that looks like a name, else the mail's local part, else the file's stem."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, 8), strip)
    word = r"[A-Za-z.'’-]+"
    good = F.filter(
        lines,
        lambda s: (s != "") & ~s.contains("@") & ~s.rlike(r"(?U)\d") & (F.length(s) <= 50) & ~s.rlike(L.java(L.NOT_A_NAME)) & s.rlike(rf"(?U)^{word}(?:\s+{word}){{1,3}}$"),
    )
    first = F.get(good, F.lit(0))
    shouted = (F.upper(first) == first) & (F.lower(first) != first)
    local = title(strip(F.regexp_replace(F.substring_index(mail, "@", 1), r"(?U)[\d_.]+", " ")))
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.when(shouted, title(first)).otherwise(first), F.nullif(local, F.lit("")), stem)


def truncated(c: Column, n: int = 12000) -> Column:
    return F.substring(c, 1, n)


def json_object(c: Column) -> Column:
    """From the first brace to the last one, code fences off."""
    start, end = lambda t: F.instr(t, "{"), lambda t: F.length(t) - F.instr(F.reverse(t), "}") + 1
    found = lambda t: F.when((start(t) > 0) & (F.instr(t, "}") > 0), F.substring(t, start(t), end(t) - start(t) + 1))
    return let(strip(F.regexp_replace(strip(c), r"(?m)^```(?:json)?|```$", "")), found)


def distinct_capped(c: Column, n: int) -> Column:
    """Distinct entries in their order, n at most."""
    return F.slice(F.array_distinct(c), 1, n)


def timestamp_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)


def general(c: Column) -> Column:
    """A number without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")
