"""PII surrogates: detected entities get keyed, type-consistent replacements.

Detected: e-mail addresses, IPv4 addresses, payment cards (13 to 19 digits with a valid check digit), IBANs (with valid
check digits), other account numbers of those forms, phone numbers, social security numbers, and personal names: after a
title, and, for a full name that stands after a title anywhere in the corpus, wherever else it stands.

One entity is a type and a normal form (case, punctuation and white space do not count), so all its mentions in the
corpus get the same surrogate (coreference), a name with whatever titles and without any. A surrogate keeps the format:
digits stay digits in the same places, letters stay letters of the same case, a card keeps its first digit and a valid
check digit, an IBAN its country and valid check digits, a phone its country code, an IP address its four octets, an
e-mail address its top-level domain; a name keeps its script (Latin, Cyrillic, Greek) and the gender that its titles
agree on in the corpus, else that of a given name listed below. Distinctness is checked over the corpus: of entities
that draw the same surrogate, or one that is a real entity, all but the first draw again until none is left. Built-in
functions only.

Every pattern begins at a bounded distance from its anchor and repeats bounded groups only, so long texts without white
space take time in proportion to their length. Entities draw in as many tasks as their number needs. Texts without an
entity pass straight through; only those with one meet the table of replacements.

Defined cases: null text stays null, empty text empty; texts are read whole at any length; repeated rows are replaced
alike; where two types match at a place, the first in `ENTITIES` wins; an e-mail address counts the last 64 characters
before its @ and ten labels after it at most; untitled names are looked for in runs of up to eight capitalised words;
an empty table gives an empty result; extra columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettle.llm.common import fresh, text_or_empty, written

MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Don", "Господин", "Κύριος"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "Госпожа", "Κυρία")
#: Given names by gender and script; family names are made of syllables.
GIVEN = {
    "mL": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Henri", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Noel", "Oscar", "Paul"),
    "fL": ("Anna", "Berta", "Clara", "Diana", "Elisa", "Fiona", "Greta", "Hanna", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"),
    "nL": ("Alex", "Andrea", "Charlie", "Dominique", "Eden", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Taylor", "Toni", "Val", "Yael"),
    "mC": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    "fC": ("Анна", "Белла", "Вера", "Галина", "Дарья", "Ева", "Зоя", "Инна", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Юлия"),
    "nC": ("Женя", "Саша", "Валя", "Паша", "Слава", "Шура", "Ася", "Мика", "Рита", "Тоша", "Люка", "Вика", "Лёва", "Надя", "Стася", "Юля"),
    "mG": ("Άγγελος", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Ιάσων", "Κώστας", "Λεωνίδας", "Μάρκος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Φώτης", "Χρήστος"),
    "fG": ("Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νεφέλη", "Ξένια", "Σοφία", "Χλόη"),
    "nG": ("Άλεξ", "Γωγώ", "Εύη", "Ζήση", "Κίμων", "Λένα", "Μέλη", "Νόα", "Ντίνα", "Ρένα", "Σάσα", "Τάσι", "Τόνια", "Φιλιώ", "Φρόσω", "Χάρι"),
}
SYLLABLES = {
    "L": ("ba", "den", "fi", "gor", "ha", "jel", "ka", "lin", "mo", "ner", "pas", "ro", "sel", "ta", "vin", "wol"),
    "C": ("ба", "ве", "гор", "да", "же", "зин", "ка", "лин", "мо", "нер", "пас", "ро", "сел", "та", "фи", "шин"),
    "G": ("βα", "γεν", "δη", "ζορ", "θα", "κελ", "λα", "μιν", "νο", "περ", "ρας", "σο", "τελ", "φα", "χιν", "ψο"),
}
TITLES = "|".join((*MALE, *FEMALE, "Dr", "Prof"))
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
#: In this order; the first that matches at a place wins.
ENTITIES = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9A-Za-z])",
    "name": rf"(?<=\b(?:{TITLES})\.? )(?!(?:{TITLES})\b){_NAME}(?: (?!(?:{TITLES})\b){_NAME}){{0,2}}",
}
#: Two to eight capitalised words, none of them a title: a full name may be among them.
UNTITLED = rf"(?<![\p{{L}}\p{{N}}'’-])(?!(?:{TITLES})\b){_NAME}(?: (?!(?:{TITLES})\b){_NAME}){{1,7}}"
#: What an entity of each type can begin with, looked at first: most places of a text begin none.
OPENS = {"email": "[A-Za-z0-9]", "iban": "[A-Z]", "name": r"\p{Lu}"}
PATTERN = "|".join(f"(?={OPENS.get(k, '[0-9+(]')})(?:{p})" for k, p in ENTITIES.items())
PATTERN_AND_UNTITLED = rf"{PATTERN}|(?=\p{{Lu}})(?:{UNTITLED})"
#: A text without these has no entity.
HINT = rf"[0-9@]|(?=[A-ZГΚ])(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}"
UNTITLED_HINT = rf"{HINT}|\p{{Lu}}\p{{L}}+ \p{{Lu}}"
#: Entities that one task draws for.
DRAWS = 2000


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def _digit(h: Column, i: Column) -> Column:
    return F.translate(F.substring(h, F.pmod(i, F.lit(60)) + 1, F.lit(1)), "abcdef", "012345")


def _shaped(value: Column, h: Column) -> Column:
    """`value` with each digit and ASCII letter replaced in its class by the hash."""
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.conv(F.substring(h, F.pmod(i * 2, F.lit(60)) + 1, F.lit(2)), 16, 10).cast("int") % 26) + 1, F.lit(1))
    one = lambda c, i: F.when(c.rlike("[0-9]"), _digit(h, i)).when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[A-Z]"), F.upper(letter(i))).otherwise(c)
    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check: every second digit from the right, the last but one first, counts double."""
    at = F.sequence(F.lit(1), F.length(digits))

    def weigh(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, F.when(d >= 5, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(at, weigh), F.lit(0), lambda a, x: a + x)


def luhn_fixed(digits: Column) -> Column:
    """`digits` with its last one made the check digit."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))


def mod97(text: Column) -> Column:
    """Remainder of digits and upper-case letters (A is 10) read as a number."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c <= "9", (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def iban_fixed(country: Column, account: Column) -> Column:
    """The IBAN of an account."""
    return F.concat(country, F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)


def kind_of(value: Column) -> Column:
    """The type of a match; card and IBAN forms that fail their check are accounts."""
    out = F.lit("name")
    for k, p in list(ENTITIES.items())[:-1][::-1]:
        found = F.lit(k)
        if k == "card":
            found = F.when(luhn_sum(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0, k).otherwise("account")
        elif k == "iban":
            plain = F.replace(value, F.lit(" "), F.lit(""))
            found = F.when(mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, k).otherwise("account")
        out = F.when(value.rlike(rf"^(?:{p})$"), found).otherwise(out)
    return out


def script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "C").when(value.rlike(r"\p{IsGreek}"), "G").otherwise("L")


def name_norm(value: Column) -> Column:
    return F.concat(script(value), F.lit(":"), F.lower(value))


def normal(kind: Column, value: Column) -> Column:
    """The entity that `value` mentions."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.coalesce(F.when(value.startswith("+"), F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[^0-9])", 1)), F.lit("")), F.lit(":"), digits))
        .when(kind.isin("iban", "account"), F.regexp_replace(value, "[ -]", ""))
        .when(kind == "name", name_norm(value))
        .otherwise(F.lower(value))
    )


def with_surrogate(df: DataFrame, key: str) -> DataFrame:
    """`df` (kind, norm, gender, attempt) with s, the surrogate of an entity at its n-th draw, in normal form."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    domain = F.substring_index(norm, "@", -1)
    df = df.withColumns({"h": _hex(key, kind, norm, attempt.cast("string")), "hd": F.when(kind == "email", _hex(key, F.lit("domain"), domain))})
    h = F.col("h")
    code, tail = F.substring_index(norm, ":", 1), F.substring_index(norm, ":", -1)
    phone = F.concat(code, F.lit(":"), code, _shaped(F.substring(tail, F.length(code) + 1, F.length(tail)), h))
    card = luhn_fixed(F.concat(F.substring(norm, 1, 1), _shaped(F.substring(norm, F.lit(2), F.length(norm)), h)))
    octet = lambda i: (F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    top = F.substring_index(domain, ".", -1)
    hosts = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    more = F.when(attempt > 3, F.substring(F.translate(h, "0123456789", "ghijklmnop"), F.lit(40), attempt)).otherwise(F.lit(""))
    email = F.concat(_shaped(F.substring_index(norm, "@", 1), h), more, F.lit("@"), _shaped(hosts, F.col("hd")), F.lit("."), top)
    pick = lambda options, i: F.get(F.array(*map(F.lit, options)), F.conv(F.substring(h, i + 1, 1), 16, 10).cast("int"))
    given, family = F.lit(""), F.lit("")
    for who, names in GIVEN.items():
        given = F.when(F.concat("gender", code) == who, F.lower(pick(names, 0))).otherwise(given)
    for letters, parts in SYLLABLES.items():
        syllables = [pick(parts, i) for i in (1, 2, 3)]
        syllables += [F.when(attempt > i - 4, pick(parts, i)).otherwise(F.lit("")) for i in (4, 5, 6, 7)]
        family = F.when(code == letters, F.concat(*syllables)).otherwise(family)
    words = F.size(F.split(tail, " "))
    middle = F.when(words > 2, F.concat(F.lit(" "), F.substring(family, 1, 5))).otherwise(F.lit(""))
    name = F.concat(code, F.lit(":"), F.when(words > 1, F.concat(given, middle, F.lit(" "))).otherwise(F.lit("")), family)
    iban = iban_fixed(F.substring(norm, 1, 2), _shaped(F.substring(norm, F.lit(5), F.length(norm)), h))
    s = F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *map(octet, range(4)))).when(kind == "card", card).when(kind == "phone", phone).when(kind == "name", name).when(kind == "iban", iban)
    return df.withColumn("s", s.otherwise(_shaped(norm, h))).drop("h", "hd")


def rendered(kind: Column, value: Column, s: Column) -> Column:
    """Surrogate `s` in the format of the mention `value`."""
    body = F.substring_index(s, ":", -1)
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    placed = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(body, before(i), F.lit(1))).otherwise(c)), "")
    cased = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(body))
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban", "account"), placed)
        .when(kind == "name", cased.otherwise(F.array_join(F.transform(F.split(body, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")))
        .otherwise(cased.otherwise(body))
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, s): distinct entities (kind, norm, gender) with distinct surrogates, none of them a real entity's."""
    entities = written(entities, "entities")
    names = entities.select("kind", F.col("norm").alias("s"))
    parts = max(1, -(-entities.count() // DRAWS))
    taken = None
    ask = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = written(with_surrogate(ask.repartition(parts, "norm"), key), "draws")
        first = drawn.groupBy("kind", "s").agg(F.min("norm").alias("first"))
        free = first.join(names, ["kind", "s"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "s"), ["kind", "s"], "left_anti")
        round_ = written(drawn.join(free, ["kind", "s"], "left").withColumn("won", F.coalesce(F.col("first") == F.col("norm"), F.lit(False))).drop("first"), "surrogates")
        won = round_.filter("won").select("kind", "norm", "s")
        taken = won if taken is None else taken.unionByName(won)
        if round_.filter("not won").isEmpty():
            return taken
        ask = round_.filter("not won").select("kind", "norm", "gender", (F.col("attempt") + 1).alias("attempt"))


def mentions(rows: DataFrame, pattern: str) -> DataFrame:
    """(hash, at, value, title) of every match in `rows` (hash, body), each text once."""
    found = F.regexp_extract_all(F.col("body"), F.lit(f"({pattern})"), F.lit(1))
    one = rows.select("hash", found.alias("found"), F.split("body", pattern, -1).alias("between"))
    each = F.transform("found", lambda v, i: F.struct(i.alias("at"), v.alias("value"), F.right(F.get(F.col("between"), i), F.lit(24)).alias("left")))
    out = one.select("hash", F.explode(each).alias("m")).select("hash", "m.at", "m.value", F.regexp_extract("m.left", rf"({TITLES})\.? $", 1).alias("title"))
    return out.groupBy("hash", "at").agg(F.first("value").alias("value"), F.first("title").alias("title"))


def gender_of(title: Column, value: Column) -> Column:
    """By the title, else by a listed given name: m, f or null."""
    given = F.substring_index(value, " ", 1)
    listed = lambda g: [n for k, names in GIVEN.items() if k[0] == g for n in names]
    both = set(listed("m")) & set(listed("f"))
    by_name = F.when(F.instr(value, " ") == 0, None).when(given.isin(*(set(listed("m")) - both)), "m").when(given.isin(*(set(listed("f")) - both)), "f")
    return F.when(title.isin(*MALE), "M").when(title.isin(*FEMALE), "F").otherwise(by_name)


def entity_table(seen: DataFrame) -> DataFrame:
    """(kind, norm, gender) of the mentions: a name's titles decide if they agree, else its given name if listed."""
    has = lambda x: F.bool_or(F.coalesce(F.col("g") == x, F.lit(False)))
    by = seen.withColumn("g", F.when(F.col("kind") == "name", gender_of(F.col("title"), F.col("value")))).groupBy("kind", "norm").agg(*(has(x).alias(f"is_{i}") for i, x in enumerate("MFmf")))
    titled = F.when(F.col("is_0") & F.col("is_1"), "n").when(F.col("is_0"), "m").when(F.col("is_1"), "f")
    gender = titled.when(F.col("is_2"), "m").when(F.col("is_3"), "f").otherwise("n")
    return by.select("kind", "norm", gender.alias("gender"))


def spans(untitled: DataFrame, names: DataFrame) -> DataFrame:
    """(hash, at, from, size, norm): the known names (norm) among capitalised words, the first and longest where they overlap."""
    words = untitled.withColumn("words", F.split("value", " "))
    at = words.withColumn("from", F.explode(F.sequence(F.lit(0), F.size("words") - 2))).withColumn("size", F.explode(F.array(F.lit(3), F.lit(2)))).filter(F.col("from") + F.col("size") <= F.size("words"))
    at = at.withColumn("norm", name_norm(F.array_join(F.slice("words", F.col("from") + 1, F.col("size")), " "))).select("hash", "at", "from", "size", "norm")
    hit = at.join(names.select("norm"), "norm").groupBy("hash", "at").agg(F.array_sort(F.collect_list(F.struct("from", (-F.col("size")).alias("less"), "norm"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast(hit.schema["hits"].dataType).alias("kept"))
    kept = F.aggregate("hits", start, lambda a, x: F.when(x["from"] >= a["end"], F.struct((x["from"] - x["less"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a))
    return hit.select("hash", "at", F.explode(kept["kept"]).alias("k")).select("hash", "at", "k.from", (-F.col("k.less")).alias("size"), "k.norm")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`docs` with its text replaced, and n_entities and kinds (the sorted types) under names that clash with nothing."""
    name = fresh(docs, "between", "n_entities", "kinds", "hash", "h", "new")
    texts = lambda hint: docs.filter(F.col(text).rlike(hint)).select(F.sha2(text, 256).alias("hash"), text_or_empty(text).alias("body"))
    typed = lambda m: m.withColumn("kind", kind_of(F.col("value"))).withColumn("norm", normal(F.col("kind"), F.col("value")))
    pattern, hint = PATTERN, HINT
    seen = written(typed(mentions(texts(hint), pattern)), "mentions")
    known = written(seen.filter("kind = 'name' and instr(value, ' ') > 0").select("norm").distinct(), "known-names")
    untitled = None
    if not known.isEmpty():
        pattern, hint = PATTERN_AND_UNTITLED, UNTITLED_HINT
        every = written(typed(mentions(texts(hint), pattern)), "mentions")
        seen = every.filter("kind <> 'name' or title <> ''")
        loose = every.filter("kind = 'name' and title = ''")
        untitled = written(spans(loose, known), "untitled-names")
    table = written(distinct_surrogates(entity_table(seen), key), "surrogate-table")
    new = seen.join(table, ["kind", "norm"]).select("hash", "at", rendered(F.col("kind"), F.col("value"), F.col("s")).alias("new"), F.lit(1).alias("n"), "kind")
    if untitled is not None:
        given = untitled.join(table.filter("kind = 'name'").select("norm", "s"), "norm")
        given = given.join(loose.select("hash", "at", "value"), ["hash", "at"]).withColumn("mention", F.array_join(F.slice(F.split("value", " "), F.col("from") + 1, F.col("size")), " "))
        given = given.withColumn("r", rendered(F.lit("name"), F.col("mention"), F.col("s"))).groupBy("hash", "at").agg(F.first("value").alias("value"), F.array_sort(F.collect_list(F.struct("from", "size", "r"))).alias("parts"))
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))
        step = lambda a, x: F.struct((x["from"] + x["size"]).alias("end"), F.concat(a["out"], F.slice(F.split("value", " "), a["end"] + 1, x["from"] - a["end"]), F.array(x["r"])).alias("out"))
        done = F.aggregate("parts", start, step, lambda a: F.array_join(F.concat(a["out"], F.slice(F.split("value", " "), a["end"] + 1, F.size(F.split("value", " ")))), " "))
        given = given.select("hash", "at", done.alias("new"), F.size("parts").alias("n"), F.lit("name").alias("kind"))
        rest = loose.join(untitled.select("hash", "at").distinct(), ["hash", "at"], "left_anti").select("hash", "at", F.col("value").alias("new"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("kind"))
        new = new.unionByName(given).unionByName(rest)
    new = new.groupBy(F.col("hash").alias(name["h"])).agg(F.array_sort(F.collect_list(F.struct("at", "new", "n", "kind"))).alias(name["new"]), F.sum("n").alias("n")).filter("n > 0").drop("n")
    new = written(new, "replacements")  # a plain side, so that adaptive execution can split a hot text's rows
    none = {name["n_entities"]: F.lit(0).cast("long"), name["kinds"]: F.lit("")}
    has = F.coalesce(F.col(text).rlike(hint) & F.col(text).rlike(pattern), F.lit(False))
    plain = docs.filter(~has).withColumns(none)
    met = docs.filter(has).withColumn(name["hash"], F.sha2(text, 256)).join(new, F.col(name["hash"]) == F.col(name["h"]), "left")
    met = met.withColumn(name["between"], F.when(F.col(name["new"]).isNotNull(), F.split(F.col(text), pattern, -1)))
    out = F.array_join(F.transform(name["between"], lambda p, i: F.concat(p, F.coalesce(F.get(F.col(name["new"]), i)["new"], F.lit("")))), "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.col(name["new"])["kind"]))), ",")
    count = F.aggregate(F.col(name["new"])["n"], F.lit(0), lambda a, x: a + x).cast("long")
    met = met.withColumns({text: F.coalesce(out, F.col(text)), name["n_entities"]: F.coalesce(count, F.lit(0).cast("long")), name["kinds"]: F.coalesce(kinds, F.lit(""))})
    return plain.unionByName(met.select(*plain.columns)), name
