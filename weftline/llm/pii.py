"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Each value found in a text is replaced by another of the same format, by a keyed permutation:
equal values get equal pseudonyms in all documents, different values different ones. The
permutation is a Feistel network of ``ROUNDS`` rounds whose round function is SHA-256 over the
key, the kind, the round and the other half. Who has the key can invert it: it is an argument without
a default.

==========  =====================================================  ==========================
kind        found when                                             permuted
==========  =====================================================  ==========================
email       address with a dotted domain                           letters and digits of the
                                                                   part before the top domain
secret      32 to 64 hexadecimal digits                            digits within digits,
                                                                   letters within a-f
phone       +country code and further digits, ``PHONE_DIGITS``     digits after the country
            in all, however grouped                                code
ipv4        four numbers up to 255                                 all 32 bits
date        real day yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy in       day number in those
            the 400 years from 1800                                400 years
ssn         ddd-dd-dddd with area, group and serial in use         the numbers in use
card        13 to 19 digits with a valid Luhn digit: unbroken or   all digits; the last is
            grouped 4-4-4-4, 4-4-4-4-3, 4-6-5 or 4-6-4 by one      computed anew
            kind of mark, alone or in a longer row of fours
==========  =====================================================  ==========================

A number that fails its test (a wrong check digit, 30 February, 300 in an address) is no personal
data and stays, and so do digits in other groups, such as tables of numbers, and fractions. Grouping marks stay where they are and don't count: a card or phone number has one
pseudonym however it's spaced.

Defined results: a null text stays null, an empty one empty; a text without findings is returned
as it is; whole texts are searched whatever their length, in time that grows with it: every pattern starts
only where a run of its characters does, and repeats a bounded number of times; where two kinds fit at one
place, the one first in ``KINDS`` is taken; repeated rows get equal results; an empty table gives an empty
one; extra columns pass through, but ``n_pseudonyms`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import unused

ROUNDS = 8
DAYS_FROM, DAYS = "1800-01-01", 146_097  # 400 years have 146097 days, 189 * 773
DAYS_A, DAYS_B = 189, 773

EMAIL = r"(?<![\p{L}\p{N}._%+\-])(?=[._%+\-]*+[\p{L}\p{N}])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9\-]{1,63}){0,30}\.[A-Za-z]{2,63}"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
NORTH_AMERICAN = r"\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
PHONE = rf"(?<![0-9A-Za-z])(?:{NORTH_AMERICAN}|\+[1-9][0-9]{{0,2}}(?:[ .\-]?\([0-9]{{1,4}}\)|[ .\-]?[0-9]{{1,5}}/(?=[0-9]))?(?:[ .\-]?[0-9]){{3,14}})(?![0-9])"
IPV4 = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]))"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
#: Marks between the groups of a card: a space or two, a no-break space, a hyphen, a dot.
MARKS = (" ", "  ", "\u00a0", "-", r"\.")
ENDS = "(?![0-9A-Za-z])"
#: Four groups of four or more, the last perhaps of three, but for a group that begins a card of three groups; or such a card.
_GROUPED = "|".join(rf"[0-9]{{4}}(?:{m}[0-9]{{4}}{ENDS}(?!{m}[0-9]{{6}}{m}[0-9]{{4,5}}{ENDS})){{3,}}+(?:{m}[0-9]{{3}}{ENDS})?+|[0-9]{{4}}{m}[0-9]{{6}}{m}[0-9]{{4,5}}" for m in MARKS)
CARD = rf"(?<![0-9A-Za-z])(?:{_GROUPED}|(?<![0-9][.,])[0-9]{{13,19}}){ENDS}"
CARD_DIGITS = (13, 19)
#: In order of preference at one place in the text.
KINDS = {"email": EMAIL, "secret": SECRET, "phone": PHONE, "ipv4": IPV4, "date": DATE, "ssn": SSN, "card": CARD}
ANY = "|".join(KINDS.values())
#: Digits of an international number, its country code included.
PHONE_DIGITS = (8, 15)
#: Country calling codes of two digits; those that begin with 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = [
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
    "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86",
    "90", "91", "92", "93", "94", "95", "98",
]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _stream(key: str, kind: str, turn: Column, place: Column, other: Column) -> Column:
    """A number below 2**48 from the round function."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), place.cast("string"), other), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def _shifted(half: Column, other: Column, turn: Column, key: str, kind: str, letters: int) -> Column:
    """``half`` with each digit and letter moved within its class by the round function."""

    def move(i: Column) -> Column:
        c = F.substring(half, i, F.lit(1))
        code, by = F.ascii(c), _stream(key, kind, turn, i, other)
        return (
            F.when(c.between("0", "9"), F.char((48 + (code - 48 + by) % 10).cast("int")))
            .when(c.between("a", "z"), F.char((97 + (code - 97 + by) % letters).cast("int")))
            .when(c.between("A", "Z"), F.char((65 + (code - 65 + by) % letters).cast("int")))
            .otherwise(c)
        )

    return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), move), ""))


def permuted_text(value: Column, key: str, kind: str, letters: int = 26) -> Column:
    """A Feistel permutation of the strings that have the character classes of ``value``."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(_shifted(s["l"], s["r"], i, key, kind, letters).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), _shifted(s["r"], s["l"], i, key, kind, letters).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A Feistel permutation of the numbers from 0 to a * b - 1."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.struct(((s["l"] + _stream(key, kind, i, F.lit(0), s["r"].cast("string"))) % a).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), ((s["r"] + _stream(key, kind, i, F.lit(0), s["l"].cast("string"))) % b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits, the last one not doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""

    def place(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), place), "")


def _email(m: Column, key: str) -> Column:
    lead = F.regexp_extract(m, r"^[._%+\-]*", 0)
    top = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    name = F.substring(m, F.length(lead) + 1, F.length(m) - F.length(lead) - F.length(top))
    return F.concat(lead, permuted_text(F.lower(name), key, "email"), top)


def _phone(m: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        code = F.when(F.substring(digits, 1, 1).isin("1", "7"), 1).when(F.substring(digits, 1, 2).isin(*TWO_DIGIT_CODES), 2).otherwise(3)
        new = F.concat(F.substring(digits, F.lit(1), code), permuted_text(F.substring(digits, code + 1, F.length(digits)), key, "phone"))
        return F.when(F.length(digits).between(*PHONE_DIGITS), _let(new, lambda d: _with_digits(m, d))).otherwise(m)

    return _let(_digits(m), moved)


def _valid_card(digits: Column) -> Column:
    return F.length(digits).between(*CARD_DIGITS) & (luhn_sum(digits) % 10 == 0)


def _card(m: Column, key: str) -> Column:
    def checked(shape: Column, body: Column) -> Column:
        check = _let(F.concat(body, F.lit("0")), lambda b: (10 - luhn_sum(b) % 10) % 10)
        return _let(F.concat(body, check.cast("string")), lambda d: _with_digits(shape, d))

    def moved(shape: Column, digits: Column) -> Column:
        return _let(permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda body: checked(shape, body))

    def among(groups: Column) -> Column:
        """A row of groups with the cards in it moved: from the left, 19 digits before 16."""
        n = F.size(groups)

        def run(i: Column, k: int) -> Column:
            return F.array_join(F.slice(groups, i + 1, F.lit(k)), "")

        def code(g: Column, i: Column) -> Column:
            long = (i + 5 == n) & (F.length(F.get(groups, n - 1)) == 3)
            four = (i + 4 <= n) & (F.length(F.get(groups, i + 3)) == 4)
            return F.when(long & _let(run(i, 5), _valid_card), "5").when(four & _let(run(i, 4), _valid_card), "4").otherwise("0")

        # each letter says how many groups a card there has; matching from left to right takes those that don't overlap
        taken = F.regexp_extract_all(F.array_join(F.transform(groups, code), ""), F.lit("5....|4...|."), F.lit(0))
        flags = F.regexp_extract_all(F.array_join(F.transform(taken, lambda t: F.concat(F.substring(t, 1, 1), F.repeat(F.lit("x"), F.length(t) - 1))), ""), F.lit("."), F.lit(0))
        mark = F.regexp_extract(m, "[0-9]([^0-9]+)", 1)

        def placed(fs: Column) -> Column:
            def one(g: Column, i: Column) -> Column:
                def card(k: int) -> Column:
                    return moved(F.call_function("array_join", F.slice(groups, i + 1, F.lit(k)), mark), run(i, k))

                return F.when(F.get(fs, i) == "0", g).when(F.get(fs, i) == "4", card(4)).when(F.get(fs, i) == "5", card(5))

            return F.call_function("array_join", F.filter(F.transform(groups, one), lambda g: g.isNotNull()), mark)

        return _let(flags, placed)

    return _let(_digits(m), lambda digits: F.when(_valid_card(digits), moved(m, digits)).when(F.length(digits) <= CARD_DIGITS[0], m).when(F.length(digits) == F.length(m), m).otherwise(_let(F.split(m, "[^0-9]+"), among)))


def _ipv4(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    part = [F.get(parts, k).cast("long") for k in range(4)]
    value = part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]
    new = permuted_number(value, 65536, 65536, key, "ipv4")
    out = _let(new, lambda n: F.concat_ws(".", *[(F.floor(n / 256**k) % 256).cast("long").cast("string") for k in (3, 2, 1, 0)]))
    return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), out).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso = F.when(m.contains("-"), m).when(m.contains("/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.datediff(iso.try_cast("date"), F.lit(DAYS_FROM).cast("date"))
    new = F.date_add(F.lit(DAYS_FROM).cast("date"), permuted_number(day.cast("long"), DAYS_A, DAYS_B, key, "date").cast("int"))
    shown = F.when(m.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.when((day >= 0) & (day < DAYS), shown).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, p, n).cast("long") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area < 666, area - 1).otherwise(area - 2)  # 898 areas in use
    new = permuted_number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")

    def shown(n: Column) -> Column:
        front = F.floor(n / 9999)
        at = F.floor(front / 99) + 1
        return F.format_string("%03d-%02d-%04d", F.when(at < 666, at).otherwise(at + 1).cast("long"), (front % 99 + 1).cast("long"), (n % 9999 + 1).cast("long"))

    return F.when(valid, _let(new, shown)).otherwise(m)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one value; the value itself if it fails its kind's test."""
    whole = {k: f"^(?:{p})$" for k, p in KINDS.items()}
    return (
        F.when(found.contains("@"), _email(found, key))
        .when(found.rlike(whole["secret"]), permuted_text(found, key, "secret", 6))
        .when(found.startswith("+"), _phone(found, key))
        .when(found.rlike(whole["ipv4"]), _ipv4(found, key))
        .when(found.rlike(whole["date"]), _date(found, key))
        .when(found.rlike(whole["ssn"]), _ssn(found, key))
        .otherwise(_card(found, key))
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced under ``key``; ``n_pseudonyms`` counts replacements."""
    docs = docs.drop("n_pseudonyms")
    body, old, new = F.col(text), unused(docs.columns, "_found"), unused(docs.columns, "_new")
    some = F.coalesce(body.rlike("[0-9@]|[A-Fa-f]{32}"), F.lit(False))  # every kind has one of these
    values = F.when(some, F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn(old, values)
    hit = F.coalesce(F.size(old), F.lit(0)) > 0
    marked = marked.withColumn(new, F.when(hit, F.transform(old, lambda m: pseudonym(m, key))))
    between = F.split(body, ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(old)), F.col(new), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    out = marked.withColumn(text, F.when(hit, joined).otherwise(body))
    changed = F.when(hit, F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda p: p))).otherwise(0)
    return out.withColumn("n_pseudonyms", changed.cast("int")).drop(old, new)
