"""Personal data replaced by format-preserving pseudonyms, in DataFrame expressions alone.

Numbers, dates and addresses are found by pattern and checked (Luhn digit, octets, calendar, mod-97). Each is permuted
within its own format by a keyed Feistel network, so equal values have equal pseudonyms in every document, different values
have different ones, and a pseudonym passes the checks that its original passed:

* e-mail: the part before @, letter by letter and digit by digit; the domain stays;
* phone: the digits but for a country prefix;
* card or account number of 13 to 19 digits with a right Luhn digit: all digits but the last, which is worked out again;
* IPv4 address: the 32 bits as two halves;
* social security number: area, group and serial within their ranges;
* date: its place among the 146,097 days of a Gregorian cycle from 1800 on; other dates stay;
* IBAN that passes mod-97: letters and digits after the check digits, which are worked out again;
* access key (AKIA and 16 signs, or a hexadecimal string of 40): sign by sign.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import let, table

ROUNDS = 8
#: Key of the permutations; a user sets one of their own.
KEY = "terracell"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind and pattern, in order of precedence at a place.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|(?<![.\d])\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)",
}
#: Days of a Gregorian cycle, as a product of two numbers, and its first day.
DAYS, DAY_A, DAY_B, FIRST_DAY = 146_097, 27, 5_411, "1800-01-01"
AREAS, SERIALS = 898, 99 * 9_999
#: Letters beyond a to z that are permuted among themselves; letters of other scripts stay.
ALPHABETS = ("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


def _stream(key: str, kind: str, turn: Column, other: Column) -> Column:
    """128 hexadecimal digits that depend on key, kind, round and the other half."""
    return F.sha2(F.concat_ws("\x1f", F.lit(f"{key}\x1f{kind}"), turn.cast("string"), other).cast("binary"), 512)


def _long_stream(key: str, kind: str, turn: Column, other: Column, signs: Column) -> Column:
    """Two hexadecimal digits for each sign or more; of up to 64 signs those of `_stream`."""
    more = lambda h: F.concat(h, F.array_join(F.transform(F.sequence(F.lit(1), F.floor((signs - 1) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", h, i.cast("string")).cast("binary"), 512)), ""))
    return let(_stream(key, kind, turn, other), lambda h: F.when(signs <= 64, h).otherwise(more(h)))


def _number(hexa: Column, start: int, n: int = 14) -> Column:
    return F.conv(F.substring(hexa, start, n), 16, 10).cast("long")


def _moved(c: Column, by: Column, hexa: bool) -> Column:
    """A sign moved on within its class; other signs stay."""
    at = F.ascii(c)
    within = lambda lo, n: F.chr(lo + F.pmod(at - lo + by, F.lit(n)))
    if hexa:
        place = F.when(c <= "9", at - 48).otherwise(at - 87)
        return F.lower(F.hex(F.pmod(place + by, F.lit(16))))
    out = F.when((c >= "0") & (c <= "9"), within(48, 10)).when((c >= "a") & (c <= "z"), within(97, 26)).when((c >= "A") & (c <= "Z"), within(65, 26))
    for letters in ALPHABETS:
        place = F.instr(F.lit(letters), c)
        out = out.when((at > 127) & (place > 0), F.substr(F.lit(letters), F.pmod(place - 1 + by, F.lit(len(letters))) + 1, F.lit(1)))
    return out.otherwise(c)


def signs(s: Column, key: str, kind: str, hexa: bool = False) -> Column:
    """A string of any length with its digits, small and capital letters permuted within their classes."""
    half = F.floor(F.length(s) / 2).cast("int")

    def turn(acc: Column, r: Column) -> Column:
        chars = F.filter(F.split(acc["x"], ""), lambda c: c != "")
        moved = let(_long_stream(key, kind, r, acc["y"], F.size(chars)), lambda h: F.array_join(F.transform(chars, lambda c, i: _moved(c, F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"), hexa)), ""))
        return F.struct(acc["y"].alias("x"), moved.alias("y"))

    start = F.struct(F.substr(s, F.lit(1), half).alias("x"), F.substr(s, half + 1).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["x"], acc["y"]))


def pairs(x: Column, y: Column, n: int, m: int, key: str, kind: str) -> Column:
    """struct<x, y> permuted over [0, n) x [0, m): each part is moved by a number that depends on the other."""

    def turn(acc: Column, r: Column) -> Column:
        first = F.pmod(acc["x"] + _number(_stream(key, kind, r, acc["y"].cast("string")), 1), F.lit(n).cast("long"))
        return let(first, lambda u: F.struct(u.alias("x"), F.pmod(acc["y"] + _number(_stream(key, kind, -r, u.cast("string")), 1), F.lit(m).cast("long")).alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def luhn_digit(digits: Column) -> Column:
    """The digit that a number without its last one needs."""
    back = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.pmod(-F.aggregate(back, F.lit(0), lambda a, v: a + v), F.lit(10))


def luhn_valid(number: Column) -> Column:
    d = F.regexp_replace(number, r"\D", "")
    return luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d)).cast("int")


def _refilled(form: Column, digits: Column) -> Column:
    """`form` with its digits replaced in order by `digits`."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    acc = F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
    is_digit = lambda c: (c >= "0") & (c <= "9")
    step = lambda a, c: F.struct(F.concat(a["s"], F.when(is_digit(c), F.substr(digits, a["n"] + 1, F.lit(1))).otherwise(c)).alias("s"), (a["n"] + F.when(is_digit(c), 1).otherwise(0)).alias("n"))
    return F.aggregate(chars, acc, step, lambda a: a["s"])


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        return let(signs(head, key, "card"), lambda p: F.concat(p, luhn_digit(p).cast("string")))

    return _refilled(m, let(F.regexp_replace(m, r"\D", ""), new))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    return F.concat(country, signs(F.substr(m, F.length(country) + 1), key, "phone"))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    half = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
    show = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), F.pmod(v, F.lit(256)).cast("string"))
    return let(pairs(half(0), half(2), 1 << 16, 1 << 16, key, "ip"), lambda p: F.concat_ws(".", show(p["x"]), show(p["y"])))


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.substring(m, i, n).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))


def _ssn_valid(m: Column) -> Column:
    a, g, s = _ssn_parts(m)
    return (a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0)


def _ssn(m: Column, key: str) -> Column:
    a, g, s = _ssn_parts(m)
    area = a - 1 - F.when(a > 666, 1).otherwise(0)

    def show(p: Column) -> Column:
        v = p["x"] + 1 + F.when(p["x"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(v.cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(p["y"], F.lit(9999)) + 1).cast("string"), 4, "0"))

    return let(pairs(area, (g - 1) * 9999 + s - 1, AREAS, SERIALS, key, "ssn"), show)


def _day(m: Column) -> Column:
    """Days since FIRST_DAY; null where no calendar has the date."""
    text = F.when(F.substring(m, 5, 1) == "-", m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date"))


def _date_valid(m: Column) -> Column:
    return F.coalesce(_day(m).between(0, DAYS - 1), F.lit(False))


def _date(m: Column, key: str) -> Column:
    iso, sep = F.substring(m, 5, 1) == "-", F.substring(m, 3, 1)

    def show(p: Column) -> Column:
        d = F.date_add(F.lit(FIRST_DAY).cast("date"), (p["x"] * DAY_B + p["y"]).cast("int"))
        return F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy")))

    return let(_day(m), lambda day: let(pairs(F.floor(day / DAY_B), F.pmod(day, F.lit(DAY_B)), DAY_A, DAY_B, key, "date"), show))


def _mod97(s: Column) -> Column:
    """Of letters (A is 10) and digits; other signs don't count."""
    step = lambda a, c: F.when((c >= "0") & (c <= "9"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).when((c >= "A") & (c <= "Z"), F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(a)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban_valid(m: Column) -> Column:
    return _mod97(F.concat(F.substr(m, F.lit(5)), F.substring(m, 1, 4))) == 1


def _iban(m: Column, key: str) -> Column:
    land, rest = F.substring(m, 1, 2), F.substr(m, F.lit(5))
    new = lambda p: F.concat(land, F.lpad((98 - _mod97(F.concat(p, land, F.lit("00")))).cast("string"), 2, "0"), p)
    return let(signs(rest, key, "iban"), new)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(signs(local, key, "email"), F.substr(m, F.length(local) + 1))


def _key(m: Column, key: str) -> Column:
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), signs(F.substr(m, F.lit(5)), key, "key"))).otherwise(signs(m, key, "hex", hexa=True))


_MAKE = {"email": _email, "key": _key, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


#: Checks of the kinds that have one.
_VALID = {"card": luhn_valid, "iban": _iban_valid, "ssn": _ssn_valid, "date": _date_valid}


def kind_of(m: Column) -> Column:
    """Kind of a value that one of the patterns matches; null where it fails its kind's check."""
    matched = F.when(m.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for k, p in list(PATTERNS.items())[1:]:
        matched = matched.when(m.rlike(f"^(?:{p})$"), k)

    def checked(k: Column) -> Column:
        out = F.lit(True)
        for name, valid in _VALID.items():
            out = F.when(k == name, valid(m)).otherwise(out)
        return F.when(out, k)

    return let(matched, checked)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """Of one value that one of the patterns matches; a value that fails its check stays as it is."""

    def by_kind(k: Column) -> Column:
        out = F.when(k == "email", _email(m, key))
        for name in list(PATTERNS)[1:]:
            out = out.when(k == name, _MAKE[name](m, key))
        return out.otherwise(m)

    return let(kind_of(m), by_kind)


def pseudonymize(docs: DataFrame, key: str = KEY, names: tuple[str, str] = ("_found", "_kinds")) -> DataFrame:
    """Documents with `text` rewritten, and the values found (in order) and their kinds added under the two `names`.

    A null text stays null and has neither; an empty one stays empty. Columns with the two names are replaced. Values that
    fail their check (a number with a wrong Luhn digit, a day that no calendar has, an IBAN with wrong digits) are not found
    and stay as they are. Repeated rows are rewritten alike; an empty table stays empty.
    """
    every = "|".join(PATTERNS.values())
    kept, found = [c for c in docs.columns if c not in names], names[0]
    some = docs.select(*[F.col(f"`{c}`") for c in kept], F.regexp_extract_all("text", F.lit(f"({every})"), F.lit(1)).alias(found))
    gaps = F.split("text", every, -1)
    new = F.when(F.size(found) > 0, let(gaps, lambda g: F.concat(g[0], F.array_join(F.transform(found, lambda m, i: F.concat(pseudonym(m, key), F.get(g, i + 1))), "")))).otherwise(F.col("text"))
    known = F.filter(F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))), lambda x: x["k"].isNotNull())
    return some.select(*[new.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], known["m"].alias(names[0]), known["k"].alias(names[1]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_found, how many of each kind, the kinds, and the rewritten text."""
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda name: F.size(F.filter("_kinds", lambda k: k == name)).cast("long")
    n = F.coalesce(F.size("_found"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_found"), *[F.coalesce(of_kind(k), F.lit(0).cast("long")).alias(f"n_{k}") for k in PATTERNS], F.array_join(F.array_sort(F.array_distinct("_kinds")), ",").alias("kinds"), "text")
