"""Personal data replaced by format-preserving Feistel pseudonyms.

Found are e-mail addresses, IBANs, calendar dates, IPv4 addresses, US social security numbers, telephone numbers, payment
card numbers and labelled hexadecimal secrets. A number or date that fails its validation (check digits, octets, calendar,
ranges) is left as it is. A valid one is written as a vector of digits with a radix each (decimal digits, letters, octets,
the two factors of a day number, ...), and ten rounds of an alternating Feistel network, keyed by HMAC-SHA-256 of the other
half, permute the vector within exactly that domain; check digits are then computed anew. So a pseudonym is valid in the
same format, equal values have equal pseudonyms in all documents, and different values of a kind stay different.

What is kept: separators, letter case, the domain of an e-mail address, the country of an IBAN, the country code of a
telephone number. Dates run from 1900 to 2099 (73,049 = 17 * 4,297 days): yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy, and
dd/mm/yyyy where only that can be meant (such a pseudonym may, rarely, be read as a mm/dd/yyyy one).
Phone numbers have 8 to 15 digits; secrets are 16 to 128 hexadecimal digits behind a word such as token and = or :, and are always
replaced, even where they look like a card or an account.

Scale. All of it is a map over rows in the JVM: no shuffle, no Python. The pattern runs only over texts with a digit or @, and
each text is cut once, so very long texts cost in proportion to their length.

Edge cases. Null text stays null, with no kinds; empty text stays empty. Repeated rows get equal results. Empty table: no
rows. Columns of the input named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+(?!1)\d{1,3}(?:[ -]?(?:\(\d{1,4}\)|\d{1,4})){2,5}(?!\d|\.\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
CARD = r"(?<![\d])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\d)"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{16})(?<=(?i:token|secret|password|passwd|api[_-]?key|apikey|access[_-]?key)[\"' ]{0,3}[=:][\"' ]{0,3})[0-9A-Fa-f]{16,128}(?![0-9A-Za-z])"
#: In order of precedence at one place. The one capturing group is that of a labelled secret.
ANY = "|".join([EMAIL, f"({SECRET})", IBAN, DATE, IPV4, SSN, PHONE, CARD])
KINDS = ("email", "iban", "date", "ipv4", "ssn", "phone", "card", "secret")


def _text(column: Column) -> Column:
    return column.cast("string")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Feistel:
    """Keyed permutations of digit vectors, as expressions."""

    def __init__(self, key: bytes):
        if not 16 <= len(key) <= 64:
            raise ValueError("a key of 16 to 64 bytes is needed")
        block = key.ljust(64, b"\0")
        self.inner, self.outer = F.lit(bytearray(b ^ 0x36 for b in block)), F.lit(bytearray(b ^ 0x5C for b in block))

    def mac(self, message: Column) -> Column:
        """HMAC-SHA-256 of a string, in hexadecimal."""
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, message.cast("binary")), 256))), 256)

    def _shifted(self, half: Column, radices: Column, other: Column, tweak: Column, turn: Column) -> Column:
        """Each digit of half plus a keyed number that depends on the other half, modulo its radix."""
        message = F.concat_ws("|", tweak, _text(turn), F.array_join(other.cast("array<string>"), ","))
        blocks = F.sequence(F.lit(0), F.floor((F.size(half) - 1) / 16).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: self.mac(F.concat(message, F.lit("#"), _text(b)))), "")
        added = F.transform(half, lambda v, j: v + F.conv(F.substring(stream, j * 4 + 1, F.lit(4)), 16, 10).cast("int"))
        return F.zip_with(added, radices, lambda v, r: v % r)

    def permuted(self, digits: Column, radices: Column, tweak: Column) -> Column:
        """digits (array of int, each below its radix) permuted within the vectors of these radices."""
        return _let(F.struct(digits.alias("digits"), radices.alias("radices"), tweak.alias("tweak")), lambda x: self._rounds(x["digits"], x["radices"], x["tweak"]))

    def _rounds(self, digits: Column, radices: Column, tweak: Column) -> Column:
        n = F.size(digits)
        h = F.floor(n / 2).cast("int")
        first, second = F.slice(radices, F.lit(1), h), F.slice(radices, h + 1, n - h)
        start = F.struct(F.slice(digits, F.lit(1), h).alias("l"), F.slice(digits, h + 1, n - h).alias("r"))

        def turn(state: Column, i: Column) -> Column:
            return F.when(
                i % 2 == 0, F.struct(state["l"].alias("l"), self._shifted(state["r"], second, state["l"], tweak, i).alias("r"))
            ).otherwise(F.struct(F.when(h > 0, self._shifted(state["l"], first, state["r"], tweak, i)).otherwise(state["l"]).alias("l"), state["r"].alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    def text(self, value: Column, alphabet: str, tweak: str) -> Column:
        """The characters of `value` that the class `alphabet` matches, permuted in their places; case and the rest stay."""
        gaps = F.split(value, alphabet, -1)
        return _let(F.regexp_extract_all(value, F.lit(alphabet), F.lit(0)), lambda chars: self._redrawn(value, chars, gaps, tweak))

    def _redrawn(self, value: Column, chars: Column, gaps: Column, tweak: str) -> Column:
        hexadecimal = tweak == "secret"
        low = F.transform(chars, F.lower)
        digits = F.transform(low, lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - (87 if hexadecimal else 97)))
        radices = F.transform(low, lambda c: F.lit(16) if hexadecimal else F.when(c.between("0", "9"), 10).otherwise(26))
        # The shape of the value is part of the tweak, so values of different shapes are permuted independently.
        shape = F.concat_ws(":", F.lit(tweak), F.array_join(radices.cast("array<string>"), ","))
        new = self.permuted(digits, radices, shape)
        if hexadecimal:
            drawn = F.transform(new, lambda v: F.when(value.rlike("[A-F]"), F.hex(v)).otherwise(F.lower(F.hex(v))))
        else:
            drawn = F.transform(F.arrays_zip(new.alias("v"), radices.alias("r"), chars.alias("c")), lambda x: F.when(x["r"] == 10, _text(x["v"])).when(x["c"].between("A", "Z"), F.char(x["v"] + 65)).otherwise(F.char(x["v"] + 97)))
        return F.array_join(F.zip_with(gaps, drawn, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    from_right = F.reverse(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda c: F.ascii(c) - 48))
    weighed = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10


def _refilled(shape: Column, digits: Column) -> Column:
    """digits in the places of the digits of shape."""
    return F.array_join(F.zip_with(F.split(shape, "[0-9]", -1), F.regexp_extract_all(digits, F.lit("[0-9]"), F.lit(0)), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, letters counting 10 to 35."""
    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.regexp_extract_all(text, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step)


def kind_of(value: Column, secret: Column) -> Column:
    """Kind of a match: secret where its label says so, whatever it looks like, else by its form."""
    return (
        F.when(secret, "secret").when(value.contains("@"), "email").when(value.rlike(f"^(?:{SSN})$"), "ssn").when(value.rlike(f"^(?:{DATE})$"), "date").when(value.rlike(f"^(?:{IPV4})$"), "ipv4")
        .when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").when(value.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & value.rlike("[G-Z]|^.{0,15}$|^..[0-9]{2}.{11,30}$") & ~value.rlike("^[A-F0-9]{32,}$"), "iban")
        .when(value.rlike(f"^(?:{CARD})$"), "card").otherwise("secret")
    )


def pseudonym(value: Column, kind: Column, feistel: Feistel) -> Column:
    """The pseudonym of a match of this kind, or the match itself where validation fails (never for a secret)."""
    digits = _digits(value)
    email = F.concat(feistel.text(F.substring_index(value, "@", 1), "[0-9A-Za-z]", "email"), F.lit("@"), F.substring_index(value, "@", -1))

    bare = F.regexp_replace(value, " ", "")
    country, account = F.substring(bare, 1, 2), F.substring(bare, F.lit(5), F.length(bare) - 4)
    new_iban = _let(feistel.text(account, "[0-9A-Z]", "iban"), lambda new: F.concat(country, F.lpad(_text(98 - _mod97(F.concat(new, country, F.lit("00")))), 2, "0"), new))
    spaced = F.array_join(F.zip_with(F.split(value, "[0-9A-Z]", -1), F.regexp_extract_all(new_iban, F.lit("[0-9A-Z]"), F.lit(0)), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    iban = F.when(_mod97(F.concat(account, F.substring(bare, 1, 4))) == 1, spaced)

    part = lambda a, b: F.substring(value, a, b)
    day_first = value.contains(".") | value.rlike("^(?:1[3-9]|[23][0-9])/")
    iso = F.when(value.rlike(r"^\d{4}"), F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2))).when(day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    first_day = F.lit("1900-01-01").cast("date")
    written = lambda d: F.when(value.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).when(value.rlike(r"^\d{4}/"), F.date_format(d, "yyyy/MM/dd")).when(value.contains("."), F.date_format(d, "dd.MM.yyyy")).when(day_first, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    moved = lambda day: feistel.permuted(F.array(day % 17, F.floor(day / 17).cast("int")), F.array(F.lit(17), F.lit(4297)), F.lit("date"))
    date = _let(F.date_diff(iso.try_cast("date"), first_day), lambda day: F.when(day.between(0, 73048), _let(moved(day), lambda m: _let(F.date_add(first_day, F.element_at(m, 1) + 17 * F.element_at(m, 2)), written))))

    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    plain = ~value.rlike(r"(^|\.)0\d")
    ipv4 = F.when(plain & F.forall(octets, lambda x: x < 256), F.array_join(feistel.permuted(octets, F.array(*[F.lit(256)] * 4), F.lit("ipv4")).cast("array<string>"), "."))

    area, group, serial = part(1, 3).cast("int"), part(5, 2).cast("int"), part(8, 4).cast("int")
    place = F.when(area < 666, area - 1).otherwise(area - 2)  # 898 areas: 1 to 899 without 666
    new = feistel.permuted(F.array(place, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"))
    area_of = lambda a: F.when(a < 665, a + 1).otherwise(a + 2)
    joined = lambda x: F.concat_ws("-", F.lpad(_text(area_of(F.element_at(x, 1))), 3, "0"), F.lpad(_text(F.element_at(x, 2) + 1), 2, "0"), F.lpad(_text(F.element_at(x, 3) + 1), 4, "0"))
    ssn = F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), _let(new, joined))

    code = F.regexp_extract(value, r"^\+(?:1|7|\d{2})", 0)
    number = F.substring(value, F.length(code) + 1, F.length(value))
    phone = F.when(F.length(digits).between(8, 15), F.concat(code, feistel.text(number, "[0-9]", "phone")))

    payload = feistel.text(F.substring(digits, F.lit(1), F.length(digits) - 1), "[0-9]", "card")
    card = F.when(_luhn(digits) == 0, _refilled(value, _let(payload, lambda new: F.concat(new, _text((10 - _luhn(F.concat(new, F.lit("0")))) % 10)))))

    secret = feistel.text(value, "[0-9A-Fa-f]", "secret")
    chosen = F.when(kind == "email", email).when(kind == "iban", iban).when(kind == "date", date).when(kind == "ipv4", ipv4).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "card", card).otherwise(secret)
    return F.coalesce(chosen, value)


def pseudonymized(docs: DataFrame, key: bytes, text_col: str = "text", kinds_col: str = "pii_kinds") -> DataFrame:
    """docs with pseudonyms in the text column; kinds_col names the kind of each replaced value, in order."""
    feistel = Feistel(key)
    text = F.col(text_col).cast("string")
    some = text.rlike("[0-9@]")
    matches = lambda group: F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(group)))
    found = docs.withColumns({"__found": matches(0), "__secret": matches(1), "__gaps": F.when(some, F.split(text, ANY, -1))})
    found = found.withColumn("__kinds", F.zip_with("__found", "__secret", lambda m, s: kind_of(m, s != "")))
    found = found.withColumn("__new", F.zip_with("__found", "__kinds", lambda m, kind: F.struct(m.alias("old"), kind.alias("kind"), pseudonym(m, kind, feistel).alias("new"))))
    joined = F.array_join(F.zip_with("__gaps", "__new", lambda gap, x: F.concat(gap, F.coalesce(x["new"], F.lit("")))), "")
    replaced = F.filter("__new", lambda x: x["old"] != x["new"])
    kinds = F.transform(replaced, lambda x: x["kind"])
    any_found = F.size(F.coalesce("__found", F.array().cast("array<string>"))) > 0
    return found.withColumns({text_col: F.when(any_found, joined).otherwise(text), kinds_col: F.when(any_found, kinds).otherwise(F.array().cast("array<string>"))}).drop("__found", "__secret", "__gaps", "__kinds", "__new")
