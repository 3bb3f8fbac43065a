"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Numbers and dates that pass their validation are permuted within their format by a keyed Feistel network
over two digit groups (or two residues, for dates and social numbers): a bijection, so equal values stay
linked across documents and different values stay apart. Cards keep a right check digit, addresses and
dates stay valid. E-mail names and secrets are no numbers; they get keyed digests in their own format.
Rounds are keyed by HMAC-SHA-256. The key comes to the rows as the two padded keys of a table of one row, so
it stands in no plan, event log or page of the interface.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_of

ROUNDS = 8

_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: What is looked for, the first kind that matches at a place is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?=[0-9A-Fa-f]{32,64}(?![A-Za-z0-9]))(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|[Aa]pi_?[Kk]ey|API_?KEY)\s{0,2}[=:]\s{0,2}[\"']?)[0-9A-Fa-f]{32,64}",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"
    rf"|(?<!\w)\d{{1,2}} {_MONTH} \d{{4}}|(?<!\w){_MONTH} \d{{1,2}}, \d{{4}})(?!\d|[./-]\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[23][0-9A-Fa-f]{3}|[fF][cdeCDE8][0-9A-Fa-f]{2}):(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d|-\d)",
    "phone": r"(?<![\d+(-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}(?:[ .-]\(?\d{2,4}\)?){2,4}|\+\d{8,15}|(?<![A-Za-z_.])[2-9]\d{9}(?![A-Za-z_]))(?!\d|-\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())  # only the card pattern has groups, so \\1 and \\2 stay right
#: A Gregorian cycle of 400 years has 146,097 = 189 * 773 days.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
SSN_AREAS = 898  # 001 to 899 without 666


@dataclass(frozen=True)
class Key:
    """The padded keys of HMAC-SHA-256, as binary columns."""

    inner: Column
    outer: Column

    def hmac(self, text: Column) -> Column:
        """In hex."""
        first = F.unhex(F.sha2(F.concat(self.inner, text.cast("binary")), 256))
        return F.sha2(F.concat(self.outer, first), 256)


def pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in raw), bytes(x ^ 0x5C for x in raw)


def _key(key: str | Key) -> Key:
    return key if isinstance(key, Key) else Key(*(F.lit(p) for p in pads(key)))


def _prf(key: str | Key, tweak: Column, turn: Column, half: Column) -> Column:
    """A keyed number of 60 bits."""
    text = F.concat_ws("|", tweak, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(_key(key).hmac(text), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, key: str | Key, tweak: Column) -> tuple[Column, Column]:
    """Permutes the pair within [0, left_mod) x [0, right_mod)."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"), left_mod.cast("long").alias("m"), right_mod.cast("long").alias("n"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, r: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_prf(key, tweak, r, s["b"]), s["m"]), s["m"]).alias("b"), s["n"].alias("m"), s["m"].alias("n")),
    )
    return end["a"], end["b"]


def _pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_permuted(digits: Column, key: str | Key, tweak: Column) -> Column:
    """Permutes digit strings of each length from 2 to 36 among themselves."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    a, b = feistel(F.substr(digits, F.lit(1), u), F.substr(digits, u + 1), _pow10(u), _pow10(n - u), key, F.concat_ws(":", tweak, n))
    return F.concat(F.lpad(a.cast("string"), u, "0"), F.lpad(b.cast("string"), n - u, "0"))


def hex_permuted(digits: Column, key: str | Key, tweak: Column) -> Column:
    """Permutes hex strings of each length up to 24 among themselves; in lower case."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    value = lambda x: F.coalesce(F.conv(x, 16, 10).cast("long"), F.lit(0).cast("long"))
    room = lambda k: F.expr("1L") * F.pow(F.lit(16), k).cast("long")
    a, b = feistel(value(F.substr(digits, F.lit(1), u)), value(F.substr(digits, u + 1)), room(u), room(n - u), key, F.concat_ws(":", tweak, n))
    return F.lower(F.concat(F.when(u > 0, F.lpad(F.hex(a), u, "0")).otherwise(F.lit("")), F.lpad(F.hex(b), n - u, "0")))


def _pour(template: Column, digits: Column, digit: str = "[0-9]") -> Column:
    """The template with its digits replaced, in order."""
    step = lambda s, c: F.when(
        c.rlike(digit), F.struct(F.concat(s["out"], F.substr(digits, s["k"] + 1, F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _email(m: Column, key: str | Key) -> Column:
    hashed = _key(key).hmac(F.concat(F.lit("email|"), F.lower(m)))
    return F.concat(F.lit("u"), F.substring(hashed, 1, 16), F.lit("@pseudonym.invalid"))


def _secret(m: Column, key: str | Key) -> Column:
    hashed = _key(key).hmac(F.concat(F.lit("secret|"), m))
    out = F.substr(hashed, F.lit(1), F.length(m))
    return F.when(m == F.upper(m), F.upper(out)).otherwise(out)


#: Formats of dates: what tells them by their look, and how they are read and written; the first that reads a date is taken.
DATE_FORMATS = (
    (r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}/", "dd/MM/yyyy"),
    (r"^[A-Z][a-z]{2} ", "MMM d, yyyy"), (r"^[A-Z][a-z]{3,} ", "MMMM d, yyyy"), (r"^\d+ [A-Z][a-z]{2} ", "d MMM yyyy"), (r"^\d+ [A-Z][a-z]{3,} ", "d MMMM yyyy"),
)


def _read_by(m: Column, look: str, how: str) -> Column:
    return F.when(m.rlike(look), F.try_to_timestamp(m, F.lit(how)).cast("date"))


def _date_value(m: Column) -> Column:
    return F.coalesce(*[_read_by(m, look, how) for look, how in DATE_FORMATS])


def _date(m: Column, key: str | Key) -> Column:
    a, b = DAYS
    index = F.datediff(_date_value(m), F.to_date(F.lit(FIRST_DAY)))
    x, y = feistel(F.floor(index / b), F.pmod(index, F.lit(b)), F.lit(a), F.lit(b), key, F.lit("date"))
    day = F.date_add(F.to_date(F.lit(FIRST_DAY)), (x * b + y).cast("int"))
    return F.coalesce(*[F.when(_read_by(m, look, how).isNotNull(), F.date_format(day, how)) for look, how in DATE_FORMATS])


def _ip(m: Column, key: str | Key) -> Column:
    o = F.split(m, "\\.")
    x, y = feistel(o[0].cast("int") * 256 + o[1].cast("int"), o[2].cast("int") * 256 + o[3].cast("int"), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.concat_ws(".", F.floor(x / 256), F.pmod(x, F.lit(256)), F.floor(y / 256), F.pmod(y, F.lit(256)))


def _ipv6(m: Column, key: str | Key) -> Column:
    """The first group stays, and so do the lengths of all groups; up to 24 digits at the end are permuted."""
    d = F.replace(m, F.lit(":"), F.lit(""))
    n, first = F.length(d), F.length(F.substring_index(m, ":", 1))
    k = F.least(n - first, F.lit(24))
    out = _pour(F.lower(m), F.concat(F.lower(F.substr(d, F.lit(1), n - k)), hex_permuted(F.substr(d, n - k + 1), key, F.lit("ipv6"))), "[0-9a-f]")
    return F.when(m == F.upper(m), F.upper(out)).otherwise(out)


def _ssn(m: Column, key: str | Key) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    left = (area - 1 - (area > 666).cast("int")) * 99 + F.substring(m, 5, 2).cast("int") - 1
    x, y = feistel(left, F.substring(m, 8, 4).cast("int") - 1, F.lit(SSN_AREAS * 99), F.lit(9999), key, F.lit("ssn"))
    a = F.floor(x / 99) + 1
    a = a + (a >= 666).cast("int")
    two = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(two(a, 3), F.lit("-"), two(F.pmod(x, F.lit(99)) + 1, 2), F.lit("-"), two(y + 1, 4))


def _card(m: Column, key: str | Key) -> Column:
    d = _digits(m)
    body = digits_permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
    check = F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.call_function("luhn_check", F.concat(body, c)))[0]
    return _pour(m, F.concat(body, check))


def _phone(m: Column, key: str | Key) -> Column:
    d = _digits(m)
    n = F.length(d)
    k = F.least(F.lit(10), F.when(m.startswith("+"), n - 2).otherwise(n))  # at least two digits of a country's code stay
    k = F.when(m.rlike(r"^\+\d[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}$"), F.lit(10)).otherwise(k)
    return _pour(m, F.concat(F.substr(d, F.lit(1), n - k), digits_permuted(F.substr(d, n - k + 1), key, F.lit("phone"))))


@dataclass(frozen=True)
class Kind:
    name: str
    valid: object
    pseudonym: object


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda o: o.cast("int") <= 255)


def _valid_date(m: Column) -> Column:
    day = _date_value(m)
    return F.coalesce(day.between("1800-01-01", "2199-12-31"), F.lit(False))


def _valid_ssn(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)") & ~m.rlike("^.{4}00") & ~m.rlike("0000$")


KINDS = (
    Kind("email", lambda m: F.lit(True), _email),
    Kind("secret", lambda m: F.lit(True), _secret),
    Kind("date", _valid_date, _date),
    Kind("ip", _octets, _ip),
    Kind("ipv6", lambda m: F.size(F.split(m, ":")) <= 8, _ipv6),
    Kind("ssn", _valid_ssn, _ssn),
    Kind("card", lambda m: F.call_function("luhn_check", _digits(m)) & ~_digits(m).rlike("^0*$"), _card),
    Kind("phone", lambda m: F.length(_digits(m)).between(8, 15), _phone),
)
#: What tells the kinds apart once a match is cut out.
SHAPES = {
    "email": "@",
    "secret": r"^[0-9A-Fa-f]{32,64}$",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}|.*[A-Z][a-z]{2,8} .*)$",
    "ip": r"^(?:\d{1,3}\.){3}\d{1,3}$",
    "ipv6": ":",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "card": r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$",
    "phone": r"",
}


def _judged(m: Column, key: Key) -> Column:
    """kind (null if the validation fails) and replacement of a match."""
    kind = value = None
    for k in KINDS:
        is_kind = m.rlike(SHAPES[k.name])
        named = F.when(k.valid(m), F.lit(k.name))
        kind = F.when(is_kind, named) if kind is None else kind.when(is_kind, named)
        put = F.when(k.valid(m), k.pseudonym(m, key)).otherwise(m)
        value = F.when(is_kind, put) if value is None else value.when(is_kind, put)
    return F.struct(kind.alias("kind"), value.alias("value"))


def _is(name: str):
    return lambda kind: kind == name


def pseudonymise(docs: DataFrame, key: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with every validated value replaced, n_replaced and a count for each kind.

    Null text counts as empty. A match that fails its validation (a card without a right check digit, an
    octet over 255, a day that doesn't exist) stays as it is. A date with slashes is read month first, or day first
    where that is the only way. Texts without a digit or "@" are passed
    through untouched. Repeated rows give repeated results, an empty table an empty one; other columns
    are dropped unless named in ``columns``. No shuffle: each text is worked on within its row.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *columns)
    found = slim.withColumn("_m", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    # One row goes to every task; it holds the key, which a literal would write into the plan.
    secret = docs.sparkSession.createDataFrame([tuple(bytearray(p) for p in pads(key))], "_inner binary, _outer binary")
    keyed = found.crossJoin(F.broadcast(secret))
    judged = keyed.withColumn("_r", F.transform("_m", lambda m: _judged(m, Key(F.col("_inner"), F.col("_outer"))))).drop("_m", "_inner", "_outer")
    parts = F.split("text", ANY, -1)
    woven = F.array_join(F.flatten(F.zip_with(parts, F.col("_r.value"), lambda p, r: F.array(p, F.coalesce(r, F.lit(""))))), "")
    kinds = F.array_compact(F.col("_r.kind"))
    out = judged.withColumn("_kinds", kinds).withColumn("text", F.when(F.size("_r") > 0, woven).otherwise(F.col("text")))
    return out.select(
        "doc_id", *columns, "text", F.size("_kinds").cast("long").alias("n_replaced"),
        *[F.size(F.filter("_kinds", _is(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS],
    )
