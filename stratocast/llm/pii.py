"""Surrogates for personal data, in DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, card numbers, phone numbers with a
country code or in a national format with separators, social security numbers,
access keys, values of password / passwd / token / secret / api key settings
(names in any case, values of eight or more of A-Z a-z 0-9 + / _ . -), and names
after a title. Each entity is replaced by a keyed surrogate of its own kind and format: digits stay digits, letters keep their case, card
numbers keep their first digit and their (in)valid check digit, phone numbers
their country code or leading 0 and a 555 exchange, addresses of one domain share a
surrogate domain, names keep title, gender and script. The same entity gets the
same surrogate in every document. Surrogates are checked for collisions over the
whole corpus and drawn again until different entities of a kind have different
surrogates and none keeps its own value.

Edge cases: null texts stay null, empty ones empty, with no entities; repeated
rows get the same result; a table without entities comes back as it is; a column
of the input named n_entities is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.llm.names import renamed, set_apart
from stratocast.storage import stored

# Patterns of the entities, in order of precedence.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
CARD = r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# National numbers: 3-3-4 digits, and a leading 0 with two to four groups. Blanks alone part only what can be an area code.
NATIONAL = (
    r"(?=[(0-9])(?<![\p{L}0-9+])(?<![0-9][.,/-])(?:"
    r"(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2}[ -][0-9]{4})"
    r"|0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})"
    r"|(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4}"
    r")(?![0-9])(?![.,/-][0-9])"
)
SETTING = r"(?i:password|passwd|token|secret|api[_-]?key)[\"']?\s{0,2}[=:]"
# The first look back is for speed only.
SECRET = rf"(?<=[=:]\s{{0,2}}[\"']?)(?<={SETTING}\s{{0,2}}[\"']?)(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{{8,}}"
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Señora", "г-жа"), "m": ("Mr", "Herr", "Señor", "г-н")}
TITLE = "(?:" + "|".join(sorted(TITLES["f"] + TITLES["m"], key=len, reverse=True)) + r")\.?"
NAME = r"\p{Lu}[\p{Ll}'-]+"
PERSON = rf"(?<![\p{{L}}]){TITLE} {NAME}(?: {NAME})?"
ANY = "|".join([EMAIL, KEY, IP, PHONE, SSN, CARD, NATIONAL, SECRET, PERSON])
# What any entity contains, to pass over other texts quickly.
HINT = rf"[0-9@]|AKIA|{TITLE} |{SETTING}"

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Clara Emma Hannah Ida Julia Laura Marta Nora Olivia Rosa Sofia".split(),
    ("m", "latin"): "Adam Bruno David Felix Hugo Jonas Leo Martin Oscar Paul Simon Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Иван Игорь Максим Олег Павел Сергей".split(),
}
SYLLABLES = {"latin": "ba de fi go ka le mi no ra se ti vo".split(), "cyrillic": "ба де ки ло ма не ри со ту ва".split()}
WIDEN_AT = 8  # draws after which a crowded format is widened


def kind_of(value: Column) -> Column:
    """The kind of a detected entity."""
    whole = {
        "email": f"^{EMAIL}$", "key": r"^AKIA[0-9A-Z]{16}$", "ip": rf"^(?:{OCTET}\.){{3}}{OCTET}$",
        "phone": r"^\+[0-9]", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "card": r"^[0-9](?:[ -]?[0-9]){12,18}$",
        "national": f"^{NATIONAL}$", "person": rf"^{TITLE} {NAME}",
    }
    kind = F.lit("secret")
    for name, pattern in reversed(whole.items()):
        kind = F.when(value.rlike(pattern), F.lit("phone" if name == "national" else name)).otherwise(kind)
    return kind


def _number(digest: Column, at: Column | int, width: int = 4) -> Column:
    """A number below 16**width from hex digits of the digest (128 of them), from place `at` on, wrapping."""
    place = (F.lit(at) if isinstance(at, int) else at) * width % (128 - width) + 1
    return F.conv(F.substr(digest, place.cast("int"), F.lit(width)), 16, 10).cast("long")


def _drawn(value: Column, digest: Column, letters_as_hex: Column) -> Column:
    """Every digit and letter replaced by one of its class; other characters stay."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        low = F.when(letters_as_hex, F.chr(97 + n % 6)).otherwise(F.chr(97 + n % 26))
        return (
            F.when(c.between("0", "9"), (n % 10).cast("string"))
            .when(c.between("a", "z"), low)
            .when(c.between("A", "Z"), F.chr(65 + n % 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column, last: Column) -> Column:
    """Luhn sum modulo 10 of a digit string whose check digit is replaced by `last`."""
    size = F.length(digits)

    def add(total: Column, x: Column) -> Column:
        doubled = (size - 1 - x["i"]) % 2 == 1
        d = F.when(x["i"] == size - 1, last).otherwise(x["d"].cast("int"))
        return total + F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    cells = F.transform(F.split(digits, ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(cells, F.lit(0), add) % 10


def _card(value: Column, drawn: Column) -> Column:
    """First digit kept; the last one set so that the Luhn sum is as far from valid as the original's."""
    body = F.concat(F.substring(value, 1, 1), F.expr("substring(_drawn, 2, length(_drawn) - 2)"))
    digits = F.regexp_replace(F.concat(body, F.lit("0")), "[ -]", "")
    original = F.regexp_replace(value, "[ -]", "")
    sum_of = _luhn(original, F.substring(original, -1, 1).cast("int"))
    check = (sum_of - _luhn(digits, F.lit(0)) + 10) % 10
    return F.concat(body, check.cast("string"))


def _phone(value: Column, drawn: Column, attempt: Column) -> Column:
    """Country code or leading 0 kept, and a 555 exchange unless the format is crowded."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}?(?=[ .(-]|[0-9]{7,})[ .-]?|^1[ .-]|^(?!\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$)\(?0(?=[1-9])", 0)
    rest = F.expr("substring(_drawn, 1 + length(_code))")
    with_555 = F.concat(F.regexp_extract(rest, r"^\(?[0-9]{3}\)?[ .-]?", 0), F.lit("555"), F.regexp_extract(rest, r"[ .-]?[0-9]{4}$", 0))
    fits = value.rlike(r"^(?:\+[0-9]{1,3}[ .-]?|1[ .-])?\(?[0-9]{3}\)?[ .-]?555[ .-]?[0-9]{4}$") & (attempt < WIDEN_AT)
    return code, F.concat(F.col("_code"), F.when(fits, with_555).otherwise(rest))


def _email(value: Column, key: str, drawn: Column, attempt: Column, digest: Column) -> Column:
    """A drawn local part at a domain that depends on the original's domain only, with its last label."""
    local = F.expr("substring(_drawn, 1, instr(value, '@') - 1)")
    wide = F.when(attempt >= WIDEN_AT, F.substring(digest, 1, 8)).otherwise("")
    domain = F.lower(F.substring_index(value, "@", -1))
    host = F.substring(F.sha2(F.concat(F.lit(key + "|domain|"), domain), 256), 1, 12)
    return F.concat(local, wide, F.lit("@d"), host, F.lit(".example."), F.substring_index(domain, ".", -1))


def _person(value: Column, key: str, attempt: Column) -> Column:
    """Title kept; given name by gender and script, surname of syllables, each by its own original."""
    name = F.regexp_replace(value, f"^{TITLE} ", "")
    female = value.rlike("^(?:" + "|".join(TITLES["f"]) + ")")
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    salt = F.concat(F.lit(key + "|name|"), attempt.cast("string"), F.lit("|"))
    surname = F.sha2(F.concat(salt, F.substring_index(name, " ", -1)), 512)
    given = F.sha2(F.concat(salt, F.substring_index(name, " ", 1)), 512)

    def pick(words: list[str], digest: Column, at: int) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (_number(digest, at, 8) % len(words) + 1).cast("int"))

    def by_script(make) -> Column:
        return F.when(cyrillic, make("cyrillic")).otherwise(make("latin"))

    first = F.when(female, by_script(lambda s: pick(GIVEN["f", s], given, 0))).otherwise(
        by_script(lambda s: pick(GIVEN["m", s], given, 0))
    )
    last = by_script(lambda s: F.initcap(F.concat(*[pick(SYLLABLES[s], surname, i) for i in range(5)])))
    full = F.when(F.instr(name, " ") > 0, F.concat(first, F.lit(" "), last)).otherwise(last)
    return F.concat(F.expr("substring(value, 1, length(value) - length(_name))"), full)


def surrogate(entities: DataFrame, key: str) -> DataFrame:
    """`entities` (kind, value, attempt) with the surrogate of that attempt."""
    value, attempt = F.col("value"), F.col("attempt")
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), attempt.cast("string"), value), 512)
    code, phone = _phone(value, F.col("_drawn"), attempt)
    octets = F.concat_ws(".", *[(_number(F.col("_digest"), i) % n + 1).cast("string") for i, n in enumerate((223, 254, 254, 254))])
    made = (
        F.when(F.col("kind") == "email", _email(value, key, F.col("_drawn"), attempt, F.col("_digest")))
        .when(F.col("kind") == "ip", octets)
        .when(F.col("kind") == "phone", phone)
        .when(F.col("kind") == "card", _card(value, F.col("_drawn")))
        .when(F.col("kind") == "key", F.concat(F.lit("AKIA"), F.expr("substring(_drawn, 5)")))
        .when(F.col("kind") == "person", _person(value, key, attempt))
        .when((F.col("kind") == "secret") & (attempt >= WIDEN_AT), F.concat("_drawn", F.substring("_digest", 1, 8)))
        .otherwise(F.col("_drawn"))
    )
    return (
        entities.withColumn("_digest", digest)
        .withColumn("_drawn", _drawn(value, F.col("_digest"), value.rlike("^[0-9a-f]+$")))
        .withColumn("_code", code)
        .withColumn("_name", F.regexp_replace(value, f"^{TITLE} ", ""))
        .select("kind", "value", "attempt", made.alias("surrogate"))
    )


def surrogate_table(entities: DataFrame, key: str, rounds: int = 100) -> DataFrame:
    """One surrogate for each distinct (kind, value), distinct within a kind and different from the value.

    The first value in order keeps a surrogate that several drew; the others
    draw again.
    """
    table = stored(surrogate(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), key))
    same = Window.partitionBy("kind", "surrogate").orderBy("attempt", "value")
    for _ in range(rounds):
        checked = table.withColumn("_again", (F.row_number().over(same) > 1) | (F.col("surrogate") == F.col("value")))
        if checked.where("_again").isEmpty():
            return table.select("kind", "value", "surrogate")
        again = checked.where("_again").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        table = stored(checked.where("NOT _again").drop("_again").unionByName(surrogate(again, key)))
    raise ValueError(f"surrogates still collide after {rounds} rounds")


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All rows of `docs` with entities in `text` replaced, and n_entities, the number of replaced places.

    Texts with entities are told apart by their md5, so equal texts are looked
    up once; texts without any stay where they are.
    """
    docs, own = set_apart(docs)
    (text,) = renamed(own, text)
    kept = [c for c in docs.columns if c != "n_entities"]
    value = F.col(text)
    found = F.when(value.rlike(HINT), F.regexp_extract_all(value, F.lit(ANY), F.lit(0))).otherwise(F.array())
    held = docs.select(*kept, F.coalesce(found, F.array()).alias("_found"))
    have = held.where(F.size("_found") > 0).withColumn("_id", F.md5(value))
    mentions = stored(
        have.select("_id", F.explode(F.array_distinct("_found")).alias("value"))
        .distinct()
        .withColumn("kind", kind_of(F.col("value")))
    )
    table = surrogate_table(mentions, key)
    names = stored(
        mentions.join(table, ["kind", "value"])
        .groupBy("_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("_names"))
    )
    gaps = F.split(value, ANY, -1)
    pieces = F.zip_with(
        gaps, F.transform("_found", lambda v: F.col("_names")[v]), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))
    )
    columns = [F.array_join(pieces, "").alias(c) if c == text else F.col(c) for c in kept]
    replaced = have.join(names, "_id").select(*columns, F.size("_found").alias("n_entities"))
    plain = held.where(F.size("_found") == 0).select(*kept, F.lit(0).alias("n_entities"))
    return plain.unionByName(replaced).withColumnsRenamed(own)
