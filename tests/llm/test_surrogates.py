"""Surrogates: format, coreference, distinctness, clean texts left alone."""

import re

from pyspark.sql import functions as F

from vettle.llm import surrogates
from vettle.llm.queries import QUERIES

ROWS = [
    (1, "Write to anna.berg@mail.example.com or ANNA.BERG@MAIL.EXAMPLE.COM, call +1 (499) 555-6503."),
    (2, "anna.berg@mail.example.com again; other: bob7@mail.example.com; phone +1-499-555-6503"),
    (3, "Card 4785380592391139 and 4785 3805 9239 1139, host 152.143.123.131, ssn 123-45-6789."),
    (4, "Frau Maria Schmidt met Mr. John Smith and Mrs. Jane Smith; Mr. John Smith left. Госпожа Анна Иванова."),
    (5, "Nothing here: version 1.2.3.4.5, 2024, price 12.50, page 300-301."),
    (6, None),
    (7, ""),
    (1, "Write to anna.berg@mail.example.com or ANNA.BERG@MAIL.EXAMPLE.COM, call +1 (499) 555-6503."),
]


def luhn(s):
    d = [int(c) for c in s]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0


def replaced(spark, rows=ROWS, key="k"):
    out, name = surrogates.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), key)
    return [(r.doc_id, r.text, r[name["n_entities"]], r[name["kinds"]]) for r in out.collect()]


def test_formats_and_coreference(spark):
    got = replaced(spark)
    assert len(got) == len(ROWS)
    t = {i: x for i, x, _, _ in got}
    for _, x in ROWS:
        for m in re.findall(r"[\w.]+@[\w.]+\.com|\d[\d ().-]{8,}\d", x or ""):
            if "version" not in x:
                assert all(m not in (y or "") for y in t.values())
    mails = re.findall(r"[\w.]+@[\w.]+\.com|[A-Z.]+@[A-Z.]+\.COM", t[1])
    assert len(mails) == 2 and mails[0].upper() == mails[1] and mails[0] in t[2]
    other = re.search(r"other: (\S+);", t[2])[1]
    assert other != mails[0] and re.fullmatch(r"[a-z]{3}\d@[a-z]{4}\.[a-z]{7}\.com", other) and other.split("@")[1] == mails[0].split("@")[1]
    phone, again = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", t[1])[0], re.search(r"\+1-\d{3}-\d{3}-\d{4}", t[2])[0]
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", again)
    cards = re.search(r"Card (\d{16}) and (\d{4} \d{4} \d{4} \d{4})", t[3])
    assert cards[1] == cards[2].replace(" ", "") and cards[1][0] == "4" and luhn(cards[1])
    ip = re.search(r"host ([\d.]+),", t[3])[1].split(".")
    assert len(ip) == 4 and all(0 < int(x) < 255 for x in ip)
    assert re.search(r"ssn \d{3}-\d{2}-\d{4}\.", t[3])
    assert t[5] == ROWS[4][1] and t[6] is None and t[7] == ""
    names = re.search(r"Frau (\S+) (\S+) met Mr. (\S+) (\S+) and Mrs. (\S+) (\S+); Mr. (\S+) (\S+) left. Госпожа (\S+) (\S+)\.", t[4])
    assert names[1] in surrogates.GIVEN["fL"] and names[3] in surrogates.GIVEN["mL"] and names[5] in surrogates.GIVEN["fL"] and names[9] in surrogates.GIVEN["fC"]
    assert (names[3], names[4]) == (names[7], names[8])


def test_keyed_and_repeatable(spark):
    a, b, c = (sorted(map(str, replaced(spark, key=k))) for k in ("k", "k", "other"))
    assert a == b and a != c


def test_distinctness_in_a_small_domain(spark):
    """ids of two digits: a thousand entities from a domain of few surrogates still differ."""
    rows = [(i, f"{chr(97 + i % 26)}{i:02d}@x.example.com") for i in range(1000)]
    got = [t for _, t, _, _ in replaced(spark, rows)]
    assert len(set(got)) == 1000 and not set(got) & {t for _, t in rows}


def test_real_entities_are_no_surrogates(spark):
    e = spark.createDataFrame([("ssn", f"{i:09d}", "n") for i in range(200)], "kind string, norm string, gender string")
    s = surrogates.distinct_surrogates(e, "k")
    assert s.count() == 200 and s.select("s").distinct().count() == 200 and s.join(e.select(F.col("norm").alias("s")), "s").count() == 0


def test_small_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_pii_surrogates"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.text == docs[r.doc_id]) == (r.n_entities == 0)
        for m in re.findall(r"[\w.]+@[\w.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b", docs[r.doc_id]):
            assert m not in r.text


def test_one_person_with_and_without_titles(spark):
    """A name is one entity across titles and where it has none; other capitalised words stay."""
    rows = [(1, "Dr. Anna Berg met Ms. Anna Berg. Anna Berg slept."), (2, "Yesterday Anna Berg And Carl Holm Came Home. ANNA"), (3, "Carl Holm is untitled here"), (4, "Prof. Carl Holm. Κυρία Ελένη Παππά, then Ελένη Παππά"), (5, "Berg Anna, no one known"), (6, "Mr. Jonas Wolf Mrs. Clara Wolf and Frau Dr. Ida Lund")]
    got = {i: (t, n, k) for i, t, n, k in replaced(spark, rows)}
    a = re.fullmatch(r"Dr\. (\S+ \S+) met Ms\. (\S+ \S+)\. (\S+ \S+) slept\.", got[1][0])
    assert a[1] == a[2] == a[3] and a[1].split()[0] in surrogates.GIVEN["fL"] and got[1][1:] == (3, "name")
    b = re.fullmatch(r"Yesterday (\S+ \S+) And (\S+ \S+) Came Home\. ANNA", got[2][0])
    assert b[1] == a[1] and got[2][1] == 2 and got[3][0] == f"{b[2]} is untitled here" and b[2].split()[0] in surrogates.GIVEN["mL"]
    g = re.fullmatch(r"Prof\. (\S+ \S+)\. Κυρία (\S+ \S+), then (\S+ \S+)", got[4][0])
    assert g[1] == b[2] and g[2] == g[3] != "Ελένη Παππά" and g[2].split()[0] in surrogates.GIVEN["fG"]
    assert got[5] == ("Berg Anna, no one known", 0, "")
    w = re.fullmatch(r"Mr\. (\S+) (\S+) Mrs\. (\S+) (\S+) and Frau Dr\. (\S+) (\S+)", got[6][0])
    assert w[1] in surrogates.GIVEN["mL"] and w[3] in surrogates.GIVEN["fL"] and got[6][1] == 3 and "Lund" not in got[6][0]


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_check_digits(spark):
    """Valid cards and IBANs stay valid; numbers of their form that fail the check are accounts of the same shape."""
    rows = [(1, "DE89 3704 0044 0532 0130 00"), (2, "DE88 3704 0044 0532 0130 00"), (3, "4785380592391139"), (4, "4785380592391138")]
    got = {i: (t, k) for i, t, _, k in replaced(spark, rows)}
    assert [got[i][1] for i in (1, 2, 3, 4)] == ["iban", "account", "card", "account"]
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", got[1][0]) and mod97(got[1][0].replace(" ", "")) == 1 and luhn(got[3][0])
    assert all(got[i][0] != t and re.sub(r"\d", "0", got[i][0])[2:] == re.sub(r"\d", "0", t)[2:] for i, t in rows)


def test_long_texts_without_space(spark):
    """Separators, long domains and long runs of words: no overflow, and time in proportion."""
    import time

    rows = [(1, "x@" + "a." * 20_000 + "com"), (2, "a-" * 100_000), (3, "a." * 50_000 + "b@x.example.com"), (4, "Anna " * 50_000), (5, "1 " * 50_000), (6, "A1B2" * 50_000), (7, "Dr. Anna Berg")]
    began = time.perf_counter()
    got = {i: (t, n) for i, t, n, _ in replaced(spark, rows)}
    assert time.perf_counter() - began < 90
    assert all(got[i][0] == t for i, t in rows if i in (2, 4)) and got[3][1] == 1 and got[7][1] == 1


def test_brute_force(spark):
    """Entities by an independent scan in Python: which texts have any, how many, and one surrogate for each entity."""
    folder = "/root/testdata/sf0.01"
    one = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|(?<![\w-])\d{3}-\d\d-\d{4}(?![\d-])|(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)|(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<!\w)\+\d{8,15}(?!\w)")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    new, old = {}, {}
    for r in QUERIES["op3_pii_surrogates"](spark, folder).collect():
        found = [m for m in one.finditer(docs[r.doc_id]) if not re.fullmatch(r"[\d.]+", m[0]) or "." not in m[0] or all(int(x) < 256 for x in m[0].split("."))]
        assert r.n_entities == len(found), (r.doc_id, found)
        end, at = 0, 0
        for m in found:
            between = docs[r.doc_id][end : m.start()]
            assert r.text[at : at + len(between)] == between
            at += len(between)
            end, said = m.end(), one.match(r.text, at)
            at = said.end()
            a, b = re.sub(r"[^a-z0-9@.]", "", m[0].lower()), re.sub(r"[^a-z0-9@.]", "", said[0].lower())
            assert new.setdefault(a, b) == b and old.setdefault(b, a) == a and a != b
        assert r.text is None or r.text[at:] == docs[r.doc_id][end:]
    assert len(new) > 5 and not set(new) & set(old)
