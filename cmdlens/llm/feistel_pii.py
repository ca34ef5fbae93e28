"""Format-preserving Feistel pseudonyms for personal data (DataFrame functions only).

One regular expression finds every place where a candidate starts (e-mail
addresses, payment-card and social-security numbers, IBANs, IPv4 addresses, phone
numbers, calendar dates). From the left, the formats that match at a place are
tried in turn, and the first value that *validates* (Luhn, mod 97, octet range, a
real calendar day, ...) is replaced; places inside it are passed over, while
those inside a candidate that fails are tried themselves. A value is permuted by a keyed Feistel network over
exactly the values of its format, so the pseudonym validates too, the text keeps
its length and layout, distinct values stay distinct, and one value gets one
pseudonym in every document.

Two networks are used. Values that number a range (days, IPv4, SSN) are split
as Z_a x Z_b with a*b the exact size of the format; strings (digits of cards and
phones, e-mail and IBAN characters) are split in halves and every character is
rotated within its own class (digit, lower, upper) by a stream drawn from the
other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# --- candidate patterns (Java regex) -------------------------------------------
# letters of a host may be of any script; those beyond a-z stay as they are
_EMAIL = r"[A-Za-z0-9._%+-]++@[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?(?:\.[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?)*\.\p{L}{2,}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_DATE = r"(?:[0-9]{4}(?<d>[-/.])[0-9]{2}\k<d>[0-9]{2}|[0-9]{2}(?<e>[-/.])[0-9]{2}\k<e>[0-9]{4})"
_CARD = (r"(?:[0-9]{13,19}|[0-9]{4}(?<c>[ -])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{1,7}"
         r"|[0-9]{4}(?<f>[ -])[0-9]{6}\k<f>[0-9]{5})")
_PHONE = (r"(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
          r"|\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}"
          r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}(?<p>[ .-])[0-9]{3}\k<p>[0-9]{4})")

# Length of an IBAN by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban_of(countries: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    grouped = "(?: [A-Z0-9]{4}){%d}" % groups + (" [A-Z0-9]{%d}" % rest if rest else "")
    return "(?:%s)[0-9]{2}(?:[A-Z0-9]{%d}|%s)" % (countries.replace(" ", "|"), length - 4, grouped)


_IBAN = "(?i:(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_iban_of(c, n) for n, c in _IBAN_LENGTHS.items()) + "))"
_IBAN_OTHER = ("(?!" + "|".join(_IBAN_LENGTHS.values()).replace(" ", "|")
               + r")[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)")
_TAIL = r"(?![0-9A-Za-z])(?![.][0-9])"
_PHONE_TAIL = r"(?:(?=[xX][0-9])|" + _TAIL + ")"  # an extension may follow
_DATE_TAIL = r"(?![0-9A-SU-Zabcdefghijklmnopqrsu-z]|[Tt](?![0-9]))(?![.][0-9])"  # a time may follow
# (kind, pattern, may a shorter run of its groups be the value), in the order they are tried
_NUMBERS = [("iban", _IBAN + _TAIL, False), ("iban", _IBAN_OTHER + _TAIL, True), ("date", _DATE + _DATE_TAIL, False),
            ("card", _CARD + _TAIL, False), ("ssn", _SSN + _TAIL, False), ("ipv4", _IPV4 + _TAIL, False),
            ("phone", _PHONE + _PHONE_TAIL, True)]
# Matches (without width) wherever a candidate starts, also inside another one. Group 1 is the e-mail address or
# what follows up to 64 characters (the longest number has 42) and an @. A candidate starts at a token start, so
# prose costs one class test per character.
START = (r"(?=((?<![0-9A-Za-z._%+@-])" + _EMAIL + r"|(?<![0-9A-Za-z])(?<![0-9][.,-])(?=[A-Z0-9+(]|[a-z]{2}[0-9]{2})(?="
         + "|".join(p for _, p, _ in _NUMBERS) + r")[^@]{1,64}))")
_BATCH = 128  # candidates of a text joined at once, so that long texts do not copy their results for each

# Days of 1900-01-01 .. 2099-12-31: 73,049 = 17 x 4,297.
_DAY0, _DAYS_A, _DAYS_B = "1900-01-01", 17, 4297


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a bare expression would be
    computed again at each use inside a lambda)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(key: str, *parts: Column, bits: int = 256) -> Column:
    """Keyed digest (hex): SHA-2 over the key and an inner keyed SHA-2 of the message."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), bits)


def _int_feistel(left: Column, right: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """Permutation of Z_a x Z_b; returns struct(x, y)."""
    def step(acc, i):
        f = F.conv(F.substring(_digest(key, F.lit(tweak), i.cast("string"), acc["y"].cast("string")), 1, 14),
                   16, 10).cast("bigint")
        m = F.when(i % 2 == 0, F.lit(a).cast("bigint")).otherwise(F.lit(b).cast("bigint"))
        return F.struct(acc["y"].alias("x"), ((acc["x"] + f) % m).alias("y"))

    start = F.struct(left.cast("bigint").alias("x"), right.cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _rotate(s: Column, stream: Column) -> Column:
    """Rotate each character of ``s`` within its class by the stream (hex digits)."""
    def one(p):
        return _let(F.substr(s, p, F.lit(1)), lambda c: turned(c, p))

    def turned(c, p):
        k = F.conv(F.substr(stream, ((p - 1) * 3) % 126 + 1, F.lit(3)), 16, 10).cast("int")

        def turn(base, size):
            return F.char(F.lit(base) + (F.ascii(c) - F.lit(base) + k) % F.lit(size))
        return (F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26))
                .when(c.between("A", "Z"), turn(65, 26)).otherwise(c))

    n = F.char_length(s)
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), ""))


def permute_string(s: Column, key: str, tweak: Column) -> Column:
    """Permutation of the strings of ``s``'s shape (its characters' classes).

    The round function reads the other half in lower case, so spellings that
    differ in case only get pseudonyms that differ in case only.
    """
    half = F.ceil(F.char_length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("x"),
                     F.substr(s, half + 1, F.greatest(F.char_length(s) - half, F.lit(0))).alias("y"))

    def step(acc, i):
        stream = _digest(key, tweak, i.cast("string"), F.lower(acc["y"]), bits=512)
        return F.struct(acc["y"].alias("x"), _let(stream, lambda st: _rotate(acc["x"], st)).alias("y"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step,
                       lambda acc: F.concat(acc["x"], acc["y"]))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of a digit string; ``shift`` 0: its last digit is the check digit, 1: it lacks one."""
    n = F.char_length(digits)

    def add(acc, p):
        v = F.ascii(F.substr(digits, n - p, F.lit(1))) - 48
        d = F.when((p + shift) % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return acc + d
    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), add)


def _spread_digits(shape: Column, digits: Column) -> Column:
    """Put ``digits`` back where ``shape`` has digits."""
    def add(acc, p):
        c = F.substr(shape, p, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substr(digits, acc["k"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(shape)),
                       F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), add, lambda acc: acc["s"])


def _mod97(s: Column) -> Column:
    """Remainder mod 97 of an IBAN body, letters counting 10..35."""
    def add(acc, p):
        c = F.substr(s, p, F.lit(1))
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), F.lit(0), add)


def _email(m: Column, key: str) -> Column:
    def with_host(host):
        tld = F.substring_index(host, ".", -1)
        site = F.substr(host, F.lit(1), F.char_length(host) - F.char_length(tld) - 1)
        user = F.substring_index(m, "@", 1)
        return F.concat(permute_string(user, key, F.concat(F.lit("user"), F.lower(host))), F.lit("@"),
                        permute_string(site, key, F.concat(F.lit("site"), F.lower(tld))), F.lit("."), tld)
    return _let(F.substring_index(m, "@", -1), with_host)


def _card(m: Column, key: str) -> Column:
    def with_body(body):
        check = ((F.lit(10) - _luhn_sum(body, 1) % 10) % 10).cast("string")
        return _let(F.concat(body, check), lambda d: _spread_digits(m, d))
    d = _only_digits(m)
    return _let(permute_string(F.substr(d, F.lit(1), F.char_length(d) - 1), key, F.lit("card")), with_body)


def _iban(m: Column, key: str) -> Column:
    def with_compact(s):
        country = F.substr(s, F.lit(1), F.lit(2))

        def with_body(body):
            check = _let(F.upper(F.concat(body, country, F.lit("00"))),
                         lambda x: F.lpad((F.lit(98) - _mod97(x)).cast("string"), 2, "0"))
            return F.concat(country, check, body)
        return _let(permute_string(F.substr(s, F.lit(5), F.char_length(s) - 4), key, F.upper(country)), with_body)
    # the blanks come back at every fifth place of the grouped spelling
    return _let(_let(F.replace(m, F.lit(" "), F.lit("")), with_compact), lambda out: F.when(
        F.contains(m, F.lit(" ")), F.rtrim(F.regexp_replace(out, "(.{4})", "$1 "))).otherwise(out))


def _iban_ok(m: Column) -> Column:
    def with_compact(s):
        n = F.char_length(s)
        moved = F.upper(F.concat(F.substr(s, F.lit(5), n - 4), F.substr(s, F.lit(1), F.lit(4))))
        return n.between(15, 34) & _let(moved, lambda x: _mod97(x) == 1)
    return _let(F.replace(m, F.lit(" "), F.lit("")), with_compact)


def _date_parts(m: Column):
    """(ISO text, is year first, is month first) of a candidate date."""
    d = _only_digits(m)
    year_first = m.rlike("^[0-9]{4}[-/.]")
    iso = F.concat_ws("-", F.substr(d, F.lit(1), F.lit(4)), F.substr(d, F.lit(5), F.lit(2)), F.substr(d, F.lit(7), F.lit(2)))
    dmy = F.concat_ws("-", F.substr(d, F.lit(5), F.lit(4)), F.substr(d, F.lit(3), F.lit(2)), F.substr(d, F.lit(1), F.lit(2)))
    mdy = F.concat_ws("-", F.substr(d, F.lit(5), F.lit(4)), F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(3), F.lit(2)))
    return year_first, iso, dmy, mdy


def _day_number(m: Column) -> Column:
    """Days since 1900-01-01, null if no real day of 1900-2099 is written.

    Day before month is read first; month before day only if that is no date.
    """
    year_first, iso, dmy, mdy = _date_parts(m)
    text = F.when(year_first, F.try_to_date(iso, "yyyy-MM-dd")).otherwise(
        F.coalesce(F.try_to_date(dmy, "yyyy-MM-dd"), F.try_to_date(mdy, "yyyy-MM-dd")))
    n = F.date_diff(text, F.lit(_DAY0).cast("date"))
    return F.when(n.between(0, _DAYS_A * _DAYS_B - 1), n)


def _date(m: Column, key: str) -> Column:
    """The order of day, month and year is kept as written."""
    year_first, _, dmy, _ = _date_parts(m)
    day_first = F.try_to_date(dmy, "yyyy-MM-dd").isNotNull()
    sep = F.regexp_extract(m, "[-/.]", 0)

    def written(new):
        y, mo, dd = (F.date_format(new, f) for f in ("yyyy", "MM", "dd"))
        return (F.when(year_first, F.concat(y, sep, mo, sep, dd)).when(day_first, F.concat(dd, sep, mo, sep, y))
                .otherwise(F.concat(mo, sep, dd, sep, y)))

    day = _let(_day_number(m), lambda n: _int_feistel(F.floor(n / _DAYS_B), n % _DAYS_B, _DAYS_A, _DAYS_B, key, "date"))
    return _let(_let(day, lambda p: F.date_add(F.lit(_DAY0).cast("date"), (p["x"] * _DAYS_B + p["y"]).cast("int"))), written)


def _ssn_ok(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9..)|-00-|-0000$")


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666 (898), groups 01-99, serials 0001-9999."""
    area = F.substr(m, F.lit(1), F.lit(3)).cast("bigint")
    a0 = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (F.substr(m, F.lit(5), F.lit(2)).cast("bigint") - 1) * 9999 + F.substr(m, F.lit(8), F.lit(4)).cast("bigint") - 1

    def written(p):
        na = F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1)
        return F.concat_ws("-", F.lpad(na.cast("string"), 3, "0"),
                           F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"))
    return _let(_int_feistel(a0, rest, 898, 99 * 9999, key, "ssn"), written)


def _octets(m: Column):
    return [F.get(F.split(m, r"\."), F.lit(i)).cast("bigint") for i in range(4)]


def _ipv4_ok(m: Column) -> Column:
    return F.greatest(*_octets(m)) <= 255


def _ipv4(m: Column, key: str) -> Column:
    """Each octet keeps its number of digits (0-9, 10-99, 100-255): string halves would
    leave the range, so the octets are numbered within their width and permuted in turn."""
    parts = F.split(m, r"\.")

    def size(o):
        return F.when(F.char_length(o) == 1, 10).when(F.char_length(o) == 2, 90).otherwise(156)

    def base(o):
        return F.when(F.char_length(o) == 1, 0).when(F.char_length(o) == 2, 10).otherwise(100)

    # unbalanced Feistel over four places: in each round one octet moves by a digest of the other three
    def step(acc, i):
        at = (i % 4).cast("int")
        others = F.array_join(F.transform(acc, lambda v, k: F.when(k == at, F.lit("*")).otherwise(v)), ".")
        move = F.conv(F.substring(_digest(key, F.lit("ipv4"), i.cast("string"), others), 1, 12), 16, 10).cast("bigint")
        return _let(move, lambda f: F.transform(acc, lambda v, k: F.when(
            k == at, (base(v) + (v.cast("bigint") - base(v) + f) % size(v)).cast("string")).otherwise(v)))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.lit(4 * ROUNDS - 1)), parts, step), ".")


def _shorter(kind: str, pattern: str, m: Column) -> Column:
    """Longest part of ``m`` up to one of its separators that has the pattern and validates, else null."""
    ends = F.filter(F.sequence(F.char_length(m) - 1, F.lit(1), F.lit(-1)), lambda n: F.substr(m, n + 1, F.lit(1)).isin(" ", ".", "-"))
    parts = F.filter(F.transform(ends, lambda n: F.substr(m, F.lit(1), n)), lambda x: x.rlike("^(?:" + pattern + ")$"))
    return F.get(F.filter(parts, lambda x: _valid(kind, x)), F.lit(0))


def _valid(kind: str, m: Column) -> Column:
    digits = F.char_length(_only_digits(m))
    return {"iban": lambda: _iban_ok(m), "date": lambda: _day_number(m).isNotNull(), "ssn": lambda: _ssn_ok(m),
            "ipv4": lambda: ~m.rlike(r"(?:^|\.)0[0-9]") & _ipv4_ok(m), "phone": lambda: digits.between(8, 15),
            "card": lambda: digits.between(13, 19) & _let(_only_digits(m), lambda d: _luhn_sum(d, 0) % 10 == 0)}[kind]()


def _value(window: Column) -> Column:
    """struct(kind, value) of the first format that validates at the start of the window, else null."""
    def tried(kind, pattern, shorter):
        def one(m):
            value = F.when(_valid(kind, m), m)
            if shorter:
                value = F.coalesce(value, _shorter(kind, pattern, m))
            return F.when(m != "", _let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))))
        return _let(F.regexp_extract(window, "^(?:" + pattern + ")", 0), one)
    return F.when(F.contains(window, F.lit("@")), F.struct(F.lit("email").alias("kind"), window.alias("value"))).otherwise(
        F.coalesce(*(tried(*n) for n in _NUMBERS)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted in place."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def with_rest(rest):
        return _let(permute_string(_only_digits(rest), key, F.concat(F.lit("phone"), code)),
                    lambda digits: _spread_digits(rest, digits))
    return F.concat(code, _let(F.substr(m, F.char_length(code) + 1, F.char_length(m)), with_rest))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii") -> DataFrame:
    """``docs`` with personal data in ``text_col`` pseudonymised, plus ``found_col`` (an
    array of struct(kind, pseudonym) in order of appearance).

    All rows and other columns stay as they are (a column already named as
    ``found_col`` is replaced). Null text stays null with an empty array; empty text has none;
    candidates that fail validation are left as written; repeated rows get equal
    results. A value may, as under any permutation, map to itself: 1 chance in
    the size of its format. IBANs count in either case, hosts of e-mail addresses in any script, and a
    phone number may have an extension, which stays. Dates need two digits for day and month. Texts of
    any length are scanned whole, in one pass.
    """
    text = F.col(text_col)
    clean = text.isNull() | ~text.rlike("[0-9@]")
    windows = F.when(clean, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(text, F.lit(START), 1))
    untouched = F.struct(text.alias("text"), F.array().cast(_FOUND).alias("found"))
    t = docs.withColumn(found_col, _let(windows, lambda w: F.when(F.size(w) == 0, untouched).otherwise(_replaced(text, w, key))))
    return t.withColumns({text_col: F.col(found_col)["text"], found_col: F.col(found_col)["found"]})


_FOUND = "array<struct<kind:string,pseudonym:string>>"


def _replaced(text: Column, windows: Column, key: str) -> Column:
    """struct(text, found) of a text with candidates."""
    def made(value):
        expr = F.when(value["kind"].isNull(), value["value"])
        for name, fn in _MAKERS.items():
            expr = expr.when(value["kind"] == name, fn(value["value"], key))
        return expr

    def part(acc, x):
        """Adds a piece of the text, which starts with a candidate unless the last value reaches into it."""
        n = F.char_length(x["piece"])

        def after(skip):
            return F.substr(x["piece"], skip + 1, n)

        def state(skip, parts, found):
            return F.struct(skip.cast("int").alias("skip"), parts.alias("parts"), found.alias("found"))

        def replaced(v, p):
            return state(F.greatest(F.char_length(v["value"]) - n, F.lit(0)),
                         F.concat(acc["parts"], F.array(p, after(F.char_length(v["value"])))),
                         F.concat(acc["found"], F.array(F.struct(v["kind"].alias("kind"), p.alias("pseudonym")))))

        fresh = _let(_value(x["window"]), lambda v: F.when(
            v.isNull(), state(F.lit(0), F.concat(acc["parts"], F.array(x["piece"])), acc["found"]))
            .otherwise(_let(made(v), lambda p: replaced(v, p))))
        inside = state(F.greatest(acc["skip"] - n, F.lit(0)), F.concat(acc["parts"], F.array(after(acc["skip"]))), acc["found"])
        return F.when(acc["skip"] > 0, inside).otherwise(fresh)

    def start(skip, parts):
        return F.struct(skip.cast("int").alias("skip"), parts.cast("array<string>").alias("parts"),
                        F.array().cast(_FOUND).alias("found"))

    def batch(items):
        def step(acc, i):
            done = F.aggregate(F.slice(items, i, F.lit(_BATCH)), start(acc["skip"], F.array()), part)
            return _let(done, lambda d: F.struct(
                d["skip"].alias("skip"), F.concat(acc["parts"], F.array(F.array_join(d["parts"], ""))).alias("parts"),
                F.concat(acc["found"], d["found"]).alias("found")))
        return lambda head: F.aggregate(
            F.sequence(F.lit(1), F.size(items), F.lit(_BATCH)), start(F.lit(0), F.array(head)), step,
            lambda acc: F.struct(F.array_join(acc["parts"], "").alias("text"), acc["found"].alias("found")))

    def with_pieces(pieces):
        # the text is cut before each candidate; no empty piece comes before one at its very start
        before = F.size(pieces) - F.size(windows)
        items = F.zip_with(F.slice(pieces, before + 1, F.size(windows)), windows,
                           lambda p, w: F.struct(p.alias("piece"), w.alias("window")))
        head = F.when(before == 0, F.lit("")).otherwise(F.get(pieces, F.lit(0)))
        return _let(items, lambda it: batch(it)(head))
    return _let(F.split(text, START, -1), with_pieces)
