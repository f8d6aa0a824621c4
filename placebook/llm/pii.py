"""Personal numbers, dates and addresses replaced by pseudonyms of the same format.

Each value is permuted by a Feistel network that is keyed by a secret and by the value's kind: equal values get equal
pseudonyms in every document, different values different ones, and a pseudonym passes the same checks as the value (a
card number's check digit, a date's calendar, an address's four bytes). Everything is expressions on columns.

Two networks are used. One changes characters in place within their class (digit by digit, letter by letter): each half
of the value shifts the other's characters. The other permutes pairs of numbers below two bounds in turn; where only some
pairs stand for a value, it is repeated until it meets one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Repetitions of the second network at most. A value of the two kinds that need any meets a valid pair in a step with a
# probability of 0.998 or more.
WALKS = 12

# Lengths of account numbers (IBAN) by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_BYTE}\.){{3}}{_BYTE}(?![0-9]|\.[0-9])"
_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])|(?<![0-9./])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# A number after a blank that is not part of the one before it; forms() puts a text's card numbers in the last place.
_CARDS, _NOTHING = "~", r"[^\s\S]"
_OTHER = rf"{_IP}|{_DATE}|{_SSN}|{_CARDS}"
_GROUP = rf"(?:[.-]?| (?!{_OTHER}))[0-9]{{2,4}}"
_WHOLE = rf"(?:[.-]?| (?!{_OTHER}|[0-9]+\.[0-9]))[0-9]{{2,4}}"
# Phone numbers have 7 to 15 digits. Those of ten digits after (area) or +1 come first, then those without a dotted number.
_SEVEN_TO_15 = r"[ .()-]{0,3}[0-9]" * 7 + r"(?:[ .()-]{0,3}[0-9])?" * 8
_ENDS_PLUS, _ENDS = rf"(?![0-9])(?<=\+{_SEVEN_TO_15})", rf"(?![0-9])(?<=\({_SEVEN_TO_15.replace('.()', '.)')})"
_TEN = r"(?<![0-9+])(?:(?:\+1[ .-]?)?\([2-9][0-9]{2}\)|\+1[ .-]?[2-9][0-9]{2})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
_PHONES = [rf"(?<![0-9+]){start}{groups}{ends}" for group in (_WHOLE, _GROUP) for start, groups, ends in (
    (r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)", rf"{_GROUP}(?:{group}){{1,3}}", _ENDS_PLUS),
    (r"\([0-9]{2,4}\)", rf"{_GROUP}(?:{group}){{1,3}}", _ENDS),
    (r"\+[0-9]{1,3}", rf"{_GROUP}(?:{group}){{1,4}}", _ENDS_PLUS),
)]

# How each kind is written. A later one is only looked for where no earlier one begins.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api_key)[ ]{0,2}[=:][ ]{0,2}[\x22']?[A-Za-z0-9+/_-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ip": _IP,
    "phone": "|".join([_TEN, *_PHONES]).replace(_CARDS, _NOTHING),
    "date": _DATE,
    "ssn": _SSN,
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
# Kinds whose check no pattern can make: a text's values that pass it are collected first, from wherever one may begin,
# and then looked for themselves.
_BY_LENGTH = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{length - 4}}}" for length, names in IBAN_LENGTHS.items())
# Of a country that is not listed, up to where one of a listed country begins.
_UNLISTED = rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?: (?!(?:{_BY_LENGTH})(?![A-Za-z0-9])))?[A-Z0-9]){{11,30}}"
IBAN_FORM = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{_BY_LENGTH}|{_UNLISTED})(?![A-Za-z0-9])))"
CARD_FORM = r"(?<![0-9])(?=([2-6](?:[0-9]{12,18}|[0-9]{3}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3}| [0-9]{6} [0-9]{4,5}|-[0-9]{6}-[0-9]{4,5}))(?![0-9])))"
# A text without any of these has no value of any kind.
HINT = r"[0-9@]|AKIA|(?i:password|passwd|token|secret|api_key)"

# Dates of two centuries are permuted among themselves, so that they stay likely ones, and all others of the years 1 to
# 9999 among theirs. A network's pairs are a few more than the days.
FIRST_DAY, DAYS, DAY_PAIRS = "1900-01-01", 73_049, (271, 270)  # up to 2099-12-31
DAYS_BEFORE, DAYS_APART, APART_PAIRS = 693_595, 3_579_010, (1892, 1892)  # from 0001-01-01 to 1899-12-31; and from 2100-01-01


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half), 512)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _shifted(text: Column, classes: Column, digest: Column) -> Column:
    """Each character moved within its class, by four digits of the digest: d digits, l and u letters, others stay."""

    def moved(old: Column, kind: Column, step: Column) -> Column:
        code = F.ascii(old)
        within = lambda base, size: F.char(base + (code - base + step) % size)
        return F.when(kind == "d", within(48, 10)).when(kind == "l", within(97, 26)).when(kind == "u", within(65, 26)).otherwise(old)

    # Cut up once, so that a long value's cost grows with its length only.
    pairs = F.arrays_zip(F.split(text, "").alias("old"), F.split(classes, "").alias("kind"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _number(F.substring(digest, i * 4 + 1, 4)).cast("int"))
    return let(steps, lambda step: F.array_join(F.transform(pairs, lambda pair, i: moved(pair["old"], pair["kind"], F.get(step, i % 32))), ""))


def permuted_characters(value: Column, classes: Column, key: str, kind: str) -> Column:
    """`value` with each half's characters shifted by the other half, in turn."""
    half = F.floor(F.char_length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), half), F.substring(value, half + 1, F.char_length(value))
    left_of, right_of = F.substring(classes, F.lit(1), half), F.substring(classes, half + 1, F.char_length(value))

    def step(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, let(_digest(key, kind, i, b), lambda digest: _shifted(a, left_of, digest))).otherwise(a).alias("a"),
            F.when(even, b).otherwise(let(_digest(key, kind, i, a), lambda digest: _shifted(b, right_of, digest))).alias("b"),
        )

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda state: F.concat(state["a"], state["b"]))


def permuted_pair(a: Column, b: Column, below_a: int, below_b: int, key: str, kind: str) -> Column:
    """The pair (a, b), each changed by the other in turn, as a struct of the same."""

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        push = lambda half: _number(F.substring(_digest(key, kind, i, half.cast("string")), 1, 15))
        return F.struct(
            F.when(even, (state["a"] + push(state["b"]) % below_a) % below_a).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise((state["b"] + push(state["a"]) % below_b) % below_b).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _fill(pattern: Column, characters: Column) -> Column:
    """`pattern` with its ASCII letters and digits replaced by the characters, in order."""
    places = F.sequence(F.lit(1), F.char_length(pattern))

    def step(state: Column, i: Column) -> Column:
        old = F.substring(pattern, i, 1)
        taken = old.rlike("[A-Za-z0-9]")
        new = F.when(taken, F.substring(characters, state["n"], 1)).otherwise(old)
        return F.struct(F.concat(state["out"], new).alias("out"), (state["n"] + taken.cast("int")).alias("n"))

    return F.aggregate(places, F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), step, lambda state: state["out"])


def _classes(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, "[A-Z]", "U"), "[a-z]", "l")
    marked = F.regexp_replace(F.regexp_replace(marked, "[0-9]", "d"), "U", "u")
    return F.regexp_replace(marked, "[^dlu]", "k")


def _luhn(digits: Column) -> Column:
    """The sum of digits and of the doubled ones' digits; the last digit is not doubled."""
    places = F.sequence(F.lit(1), F.char_length(digits))

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((F.char_length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), step)


def _mod97(text: Column) -> Column:
    """The remainder of digits and letters (A = 10) read as one number."""
    places = F.sequence(F.lit(1), F.char_length(text))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(text, i, 1))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(places, F.lit(0), step)


def _email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(permuted_characters(local, _classes(local), key, "email"), F.lit("@"), domain)


def _key(m: Column, key: str) -> Column:
    rest = F.substring(m, F.lit(5), F.lit(16))
    return F.concat(F.lit("AKIA"), permuted_characters(rest, _classes(rest), key, "key"))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]+$", 0)
    start = F.substring(m, F.lit(1), F.char_length(m) - F.char_length(value))
    return F.concat(start, permuted_characters(value, _classes(value), key, "secret"))


def _valid_iban(m: Column) -> Column:
    return let(F.regexp_replace(m, " ", ""), lambda plain: _mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    def replaced(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, 5, 40)

        def checked(new: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return _fill(m, F.concat(country, check, new))

        return let(permuted_characters(rest, _classes(rest), key, "iban"), checked)

    return let(F.regexp_replace(m, " ", ""), replaced)


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.split(m, r"\.")[i].cast("int")
    pair = permuted_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 1 << 16, 1 << 16, key, "ip")
    bytes_of = lambda n: [F.floor(n / 256).cast("string"), (n % 256).cast("string")]
    return let(pair, lambda p: F.concat_ws(".", *bytes_of(p["a"]), *bytes_of(p["b"])))


def _phone(m: Column, key: str) -> Column:
    """The country's code stays: the digits after + up to the next sign, of a number written without any the first."""
    start = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9])?", 0)
    rest = F.substring(m, F.char_length(start) + 1, F.lit(64))
    digits = _digits(rest)
    return F.concat(start, _fill(rest, permuted_characters(digits, F.repeat(F.lit("d"), F.char_length(digits)), key, "phone")))


def _date(m: Column, key: str) -> Column:
    """Year, month and day, or day, month and year; with slashes month, day and year where only that is a date. Days and
    months have a leading zero if either of the value's has one or both have two digits.
    """
    number = lambda i: F.regexp_extract(m, r"^([0-9]+)[^0-9]([0-9]+)[^0-9]([0-9]+)$", i)
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", number(y), F.lpad(number(mo), 2, "0"), F.lpad(number(d), 2, "0")), "yyyy-MM-dd")
    iso, slashes = F.substring(m, 5, 1) == "-", m.contains("/")
    day_first, month_first = made(3, 2, 1), made(3, 1, 2)
    first = F.lit(FIRST_DAY).cast("date")
    wide = (F.char_length(number(1)) == 2) & (F.char_length(number(2)) == 2)

    def walked(n: Column, days: int, pairs: tuple[int, int], kind: str) -> Column:
        def step(state: Column, i: Column) -> Column:
            pair = permuted_pair(F.floor(state["n"] / pairs[1]), state["n"] % pairs[1], *pairs, key, kind)
            onward = let(pair, lambda p: p["a"] * pairs[1] + p["b"])
            return F.when((i == 0) | (state["n"] >= days), F.struct(onward.alias("n"))).otherwise(state)

        return F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), F.struct(n.cast("long").alias("n")), step, lambda state: state["n"])

    def written(new: Column) -> Column:
        short = lambda n: F.when(wide, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
        day, month, year = short(F.dayofmonth(new)), short(F.month(new)), F.lpad(F.year(new).cast("string"), 4, "0")
        other = F.when(slashes & day_first.isNull(), F.concat_ws("/", month, day, year))
        other = other.when(slashes, F.concat_ws("/", day, month, year)).otherwise(F.concat_ws(".", day, month, year))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other)

    def replaced(found: Column) -> Column:
        day = F.datediff(found, first)
        new = lambda n: written(F.date_add(first, n.cast("int")))
        far = lambda n: new(F.when(n < DAYS_BEFORE, n - DAYS_BEFORE).otherwise(n - DAYS_BEFORE + DAYS))
        place = F.when(day < 0, day + DAYS_BEFORE).otherwise(day + DAYS_BEFORE - DAYS)
        near = let(walked(day, DAYS, DAY_PAIRS, "date"), new)
        return F.when(day.between(0, DAYS - 1), near).otherwise(F.when(day >= -DAYS_BEFORE, let(walked(place, DAYS_APART, APART_PAIRS, "date apart"), far)))

    value = F.when(iso, made(1, 2, 3)).when(slashes, F.coalesce(day_first, month_first)).otherwise(day_first)
    return let(value, replaced)


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.split(m, "-")[i].cast("int")
    area, group, serial = part(0), part(1), part(2)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    front = (area - 1 - (area > 666).cast("int")) * 99 + group - 1

    def written(p: Column) -> Column:
        new = F.floor(p["a"] / 99) + 1
        new = new + (new >= 666).cast("int")
        pad = lambda n, width: F.lpad(n.cast("string"), width, "0")
        return F.concat_ws("-", pad(new, 3), pad(p["a"] % 99 + 1, 2), pad(p["b"] + 1, 4))

    return F.when(valid, let(permuted_pair(front, serial - 1, 898 * 99, 9999, key, "ssn"), written))


def _valid_card(m: Column) -> Column:
    return let(_digits(m), lambda digits: digits.rlike("^[2-6]") & (_luhn(digits) % 10 == 0))


def _card(m: Column, key: str) -> Column:
    """The first digit, which names the network, stays; the check digit is that of the new number."""

    def replaced(digits: Column) -> Column:
        inner = F.substring(digits, F.lit(2), F.char_length(digits) - 2)
        new = permuted_characters(inner, F.repeat(F.lit("d"), F.char_length(inner)), key, "card")

        def checked(body: Column) -> Column:
            front = F.concat(F.substring(digits, 1, 1), body)
            check = (10 - _luhn(F.concat(front, F.lit("0"))) % 10) % 10
            return _fill(m, F.concat(front, check.cast("string")))

        return let(new, checked)

    return let(_digits(m), replaced)


REPLACED = {"email": _email, "key": _key, "secret": _secret, "iban": _iban, "ip": _ip, "phone": _phone, "date": _date, "ssn": _ssn, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind of a match: the first whose form all of it has."""
    kind = F.lit(None).cast("string")
    for name, form in reversed(KINDS.items()):
        kind = F.when(m.rlike(f"^(?:{form})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """A match's pseudonym, or null where the match is not valid."""
    new = F.lit(None).cast("string")
    for name, made in REPLACED.items():
        new = F.when(kind == name, made(m, key)).otherwise(new)
    return new


def forms(text: Column) -> Column:
    """The pattern of all values of a text: how each kind is written, but for account and card numbers the text's own."""

    def values(form: str, valid: Callable[[Column], Column]) -> Column:
        return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(form), F.lit(1))), valid)

    def either(found: Column, start: str, after: str) -> Column:
        """Any of the values; they are only tried where one may begin."""
        return F.when(F.size(found) > 0, F.concat(F.lit(f"(?={start})(?:"), F.array_join(found, "|"), F.lit(f")(?!{after})")))

    def pattern(iban: Column, card: Column) -> Column:
        phone = F.when(card.isNull(), F.lit(KINDS["phone"])).otherwise(F.replace(F.lit("|".join([_TEN, *_PHONES])), F.lit(_CARDS), card))
        own = {"iban": F.concat(F.lit("(?<![A-Za-z0-9])"), iban), "phone": phone, "card": F.concat(F.lit("(?<![0-9])"), card)}
        return F.concat_ws("|", *[own.get(kind, F.lit(form)) for kind, form in KINDS.items()])

    iban = let(values(IBAN_FORM, _valid_iban), lambda found: either(found, "[A-Z]{2}[0-9]{2}", "[A-Za-z0-9]"))
    card = let(values(CARD_FORM, _valid_card), lambda found: either(found, "[2-6][0-9]{3}[ 0-9-][0-9]{4}", "[0-9]"))
    return let(F.struct(iban.alias("iban"), card.alias("card")), lambda own: pattern(own["iban"], own["card"]))


def _pieces(text: Column, pattern: Column, named: Callable[[Column], Column], between: Callable[[Column], Column]) -> Column:
    """A text's pieces in order: its matches and what `between` makes of each piece before, between and after them."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast(PIECES)
    return F.flatten(F.zip_with(gaps, matches, lambda gap, m: F.concat(between(gap), F.when(m.isNull(), none).otherwise(F.array(named(m))))))


PIECES = "array<struct<value:string,kind:string,new:string>>"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `text` pseudonymised and a column `pseudonyms`, which replaces one of that name: the kind and the
    pseudonym of each replaced value, in order. A null text stays null and has none; matches that fail their kind's
    check stay as they are; every row stays. The key is a secret of the caller.

    Digits in other groups than a card's count as one where all of a run between other values passes the check.
    """
    nothing = F.lit(None).cast("string")

    def piece(value: Column, kind: Column, new: Column) -> Column:
        return F.struct(value.alias("value"), kind.alias("kind"), new.alias("new"))

    def named(m: Column) -> Column:
        return let(kind_of(m), lambda kind: piece(m, kind, pseudonym(m, kind, key)))

    def run(m: Column) -> Column:
        return piece(m, F.lit("card"), F.when(_valid_card(m), _card(m, key)))

    def between(text: Column) -> Column:
        return _pieces(text, F.lit(KINDS["card"]), run, lambda gap: F.array(piece(gap, nothing, nothing)))

    marked = docs.withColumn("_forms", F.when(F.col("text").rlike(HINT), forms(F.col("text"))))
    marked = marked.withColumn("_found", F.when(F.col("_forms").isNotNull(), _pieces(F.col("text"), F.col("_forms"), named, between)).otherwise(F.array().cast(PIECES)))
    valid = F.filter("_found", lambda f: f["new"].isNotNull())
    marked = marked.withColumn("pseudonyms", F.transform(valid, lambda f: F.struct(f["kind"].alias("kind"), f["new"].alias("new"))))
    joined = F.array_join(F.transform("_found", lambda f: F.coalesce(f["new"], f["value"])), "")
    return marked.withColumn("text", F.when(F.size("_found") > 0, joined).otherwise(F.col("text"))).drop("_found", "_forms")
