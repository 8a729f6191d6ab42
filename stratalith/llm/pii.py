"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their own validation are permuted by a keyed Feistel
network inside their format: a card number keeps its length, separators and a right
check digit, an address its octets, a date its calendar.  The permutation depends on
the digits, not on the separators, so equal values stay linked across documents and
different values stay different.  Mail names and credentials go through the same network
on characters, each within its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kinds and the patterns that find their candidates, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,24}\b",
    "secret": r"(?i:token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9+/_-]{12,}|\bAKIA[A-Z0-9]{16}\b",
    "date": r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # any area and exchange after +1 or in parentheses, else only what the numbering plan allows
    "phone": r"(?<![\w.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
    r"|(?:1[ .-]?)?[2-9]\d{2}[ .-][2-9]\d{2}[ .-]\d{4}|(?<![+-])1?[2-9]\d{2}[2-9]\d{6}(?![.-]\d))(?!\w)",
    "abroad": r"(?<!\w)\+[2-9]\d{0,2}[ .-](?:\(?\d{1,5}\)?[ .-]?){1,5}\d(?!\w)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
#: What a text has at least if any pattern matches in it.
GATE = r"[0-9@]|AKIA|(?i:token|passw|secret|api[_-]?key)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days of a 28-year stretch of the calendar, as the product of the two halves of the network.
CYCLE_DAYS, CYCLE_HALVES, FIRST_YEAR, LAST_YEAR = 10227, (21, 487), 1901, 2096


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _noise(key: str, kind: str, turn: Column, half: Column) -> Column:
    """60 bits of a keyed hash."""
    said = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(u: Column, v: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (u, v) below (a, b): in turn each half is shifted by a hash of the other."""
    start = F.struct(u.cast("long").alias("u"), v.cast("long").alias("v"))

    def step(s: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        left = F.when(even, F.pmod(s["u"] + F.pmod(_noise(key, kind, turn, s["v"]), a), a)).otherwise(s["u"])
        right = F.when(even, s["v"]).otherwise(F.pmod(s["v"] + F.pmod(_noise(key, kind, turn, s["u"]), b), b))
        return F.struct(left.alias("u"), right.alias("v"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _long(n) -> Column:
    return F.lit(n).cast("long")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _permuted_digits(d: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 places under the network on its two halves."""
    half = F.floor(F.length(d) / 2).cast("int")
    tens = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = feistel(F.substr(d, F.lit(1), half).cast("long"), F.substr(d, half + 1).cast("long"), tens(half), tens(F.length(d) - half), key, kind)
    return bound(pair, lambda s: F.concat(F.lpad(s["u"].cast("string"), half, "0"), F.lpad(s["v"].cast("string"), F.length(d) - half, "0")))


def _refill(shape: Column, digits: Column) -> Column:
    """The text of ``shape`` with its digits replaced in order."""
    place = lambda i: F.length(_digits(F.substr(shape, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, place(i), F.lit(1))).otherwise(c)), "")


def _luhn(payload: Column) -> Column:
    """The check digit of a digit string."""
    n = F.length(payload)
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    at = lambda i: F.substr(payload, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    payload = lambda d: F.substr(d, F.lit(1), F.length(d) - 1)

    def of(d: Column) -> Column:
        valid = (_luhn(payload(d)) == F.substr(d, F.length(d))) & ~d.rlike(r"^(\d)\1*$")
        return F.when(valid, bound(_permuted_digits(payload(d), key, "card"), lambda p: _refill(m, F.concat(p, _luhn(p)))))

    return bound(_digits(m), of)


def _phone(m: Column, key: str) -> Column:
    """Area and exchange each stay below 200 or from 200 on, so that a number that the plan allows stays one."""

    def of(d: Column) -> Column:
        lead, own = F.substr(d, F.lit(1), F.length(d) - 10), F.substr(d, F.length(d) - 9)
        part = lambda at, n: F.substr(own, F.lit(at), F.lit(n)).cast("long")
        area, exchange = (F.when(part(at, 3) < 200, 0).otherwise(200) for at in (1, 4))
        a, b = (F.when(low == 0, _long(200)).otherwise(_long(800)) for low in (area, exchange))
        pair = feistel(part(1, 3) - area, (part(4, 3) - exchange) * 10000 + part(7, 4), a, b * 10000, key, "phone")
        shown = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return bound(pair, lambda s: _refill(m, F.concat(lead, shown(s["u"] + area, 3), shown(s["v"] + exchange * 10000, 7))))

    return bound(_digits(m), of)


def _abroad(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d+", 0)
    rest = F.substr(m, F.length(country) + 1)
    return F.when(F.length(_digits(m)).between(8, 15), F.concat(country, bound(_digits(rest), lambda d: _refill(rest, _permuted_digits(d, key, "abroad")))))


def _ip(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        pair = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), key, "ip")
        octets = lambda s: F.array(*(F.pmod(F.floor(s[h] / k).cast("long"), _long(256)).cast("string") for h in "uv" for k in (256, 1)))
        return F.when(F.forall(o, lambda x: x <= 255), bound(pair, lambda s: F.array_join(octets(s), ".")))

    return bound(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), of)


def _ssn(m: Column, key: str) -> Column:
    def of(p: Column) -> Column:
        valid = p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        pair = feistel(area, (p[1] - 1) * 9999 + p[2] - 1, _long(898), _long(99 * 9999), key, "ssn")
        first = lambda s: s["u"] + F.when(s["u"] >= 665, 2).otherwise(1)
        group, serial = lambda s: F.floor(s["v"] / 9999).cast("long") + 1, lambda s: F.pmod(s["v"], _long(9999)) + 1
        padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.when(valid, bound(pair, lambda s: F.concat_ws("-", padded(first(s), 3), padded(group(s), 2), padded(serial(s), 4))))

    return bound(F.transform(F.split(m, "-"), lambda x: x.cast("long")), of)


def _date(m: Column, key: str) -> Column:
    """A day moves within its 28-year stretch; slashes are month first, or day first where that is the only date."""
    iso, dotted = m.rlike("^....-"), m.contains(".")
    month_first = ~iso & ~dotted & (F.substr(m, F.lit(1), F.lit(2)).cast("int") <= 12)
    pattern = F.when(iso, "yyyy-MM-dd").when(dotted, "dd.MM.yyyy").when(month_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    places = lambda y, mo, d: F.concat_ws("-", F.substr(m, F.lit(y), F.lit(4)), F.substr(m, F.lit(mo), F.lit(2)), F.substr(m, F.lit(d), F.lit(2)))
    plain = F.when(iso, m).when(month_first, places(7, 1, 4)).otherwise(places(7, 4, 1))

    def of(day: Column) -> Column:
        start = F.make_date(F.lit(FIRST_YEAR) + F.floor((F.year(day) - FIRST_YEAR) / 28).cast("int") * 28, F.lit(1), F.lit(1))
        n = F.date_diff(day, start).cast("long")
        a, b = CYCLE_HALVES
        pair = feistel(F.floor(n / b), F.pmod(n, _long(b)), _long(a), _long(b), key, "date")
        moved = bound(pair, lambda s: F.date_add(start, (s["u"] * b + s["v"]).cast("int")))
        shown = F.when(pattern == "yyyy-MM-dd", moved.cast("string"))
        for p in ("dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"):
            shown = shown.when(pattern == p, F.date_format(moved, p))
        return F.when(F.year(day).between(FIRST_YEAR, LAST_YEAR), shown.otherwise(moved.cast("string")))

    return bound(F.try_to_date(plain, "yyyy-MM-dd"), of)


def _letters(s: Column, key: str, kind: str) -> Column:
    """A string under the network on its two halves of characters, each kept in its class."""
    half = F.floor(F.length(s) / 2).cast("int")

    def moved(text: Column, by: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = F.conv(F.substr(by, 1 + F.pmod(2 * i, F.lit(64)), F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            turn = lambda low, n: F.chr(low + F.pmod(code - low + shift, F.lit(n)))
            return F.when(c.rlike("[0-9]"), turn(48, 10)).when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def step(p: Column, turn: Column) -> Column:
        by = lambda other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256)
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(p["u"], by(p["v"]))).otherwise(p["u"]).alias("u"), F.when(even, p["v"]).otherwise(moved(p["v"], by(p["u"]))).alias("v"))

    start = F.struct(F.substr(s, F.lit(1), half).alias("u"), F.substr(s, half + 1).alias("v"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda p: F.concat(p["u"], p["v"]))


def _email(m: Column, key: str) -> Column:
    return F.concat(_letters(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"[A-Za-z0-9+/_-]{12,}$", 0)
    value = F.when(m.startswith("AKIA"), F.substr(m, F.lit(5))).otherwise(value)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value)), _letters(value, key, "secret"))


_MAKERS = {"email": _email, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of a candidate: its kind and its replacement, both null if it is not valid."""
    kind, value = None, None
    for name, pattern in PATTERNS.items():
        # alone, a candidate has no neighbours for the pattern to look at
        hit = m.rlike(rf"\A(?:{pattern})\z")
        made = _MAKERS[name](m, key)
        kind, value = (F.when(hit, F.lit(name)), F.when(hit, made)) if kind is None else (kind.when(hit, F.lit(name)), value.when(hit, made))
    return bound(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value")))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_values, kinds, text), one row for every row of ``docs``, without a shuffle.

    ``text`` has every valid value replaced by its pseudonym under ``key``, which belongs
    in a secret store; ``kinds`` lists the kinds found, in order of appearance.
    Candidates that fail validation stay as they are.  A null text stays null and an
    empty one empty; repeated rows and null ids keep their rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = F.when(F.col("text").rlike(GATE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    # rows without a candidate, nearly all, skip the machinery
    made = F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(m, key)))
    held = held.withColumn("made", made)
    pieces = F.split("text", ANY, -1)
    kept = F.zip_with("found", "made", lambda m, p: F.coalesce(p["value"], m))
    text = F.when(
        F.size("found") > 0, F.array_join(F.zip_with(pieces, F.concat(kept, F.array(F.lit(""))), lambda p, m: F.concat(p, m)), "")
    ).otherwise(F.col("text"))
    kinds = F.coalesce(F.filter(F.transform("made", lambda p: p["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return held.select("doc_id", F.size(kinds).cast("long").alias("n_values"), kinds.alias("kinds"), text.alias("text"))
