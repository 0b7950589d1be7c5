"""Format-preserving pseudonyms for personal data, in SQL functions alone.

Numbers and dates that pass validation are permuted within their format by a keyed Feistel network over two halves of
mixed radix, so that the result is valid again, equal values stay equal in all documents, and different values of one
format stay different:

* payment cards (13 to 19 digits, Luhn): first digit and separators stay, the check digit is computed anew;
* dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy; real calendar days): permuted within their century;
* IPv4 addresses (octets up to 255): permuted as two halves of 16 bits;
* social-security numbers (area, group and serial in range): permuted among the valid ones;
* phone numbers of ten digits after an optional country code: the ten digits are permuted;
* e-mail addresses and long hexadecimal secrets have no small domain: the local part and the digits are replaced by a
  keyed digest of the same alphabet (length kept for secrets, the domain kept for addresses).

Whatever fails validation stays as it is. Nothing is shuffled: a pseudonym depends on the value and the key only.

Defined cases: a null text stays null with no findings; an empty text stays empty; texts without findings are returned
unchanged; repeated rows give repeated results; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "change-this-key"
ROUNDS = 8

# The forms looked for, and the days of a century as two factors (with and without its leap day).
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])"
DATE = r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{13,19}+|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}+|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
CENTURY = {36525: (75, 487), 36524: (92, 397)}

FORMS: list[tuple[str, str]] = [("email", EMAIL), ("secret", SECRET), ("date", DATE), ("ipv4", IPV4), ("social", SOCIAL), ("card", CARD), ("phone", PHONE)]
_ANY = "|".join(f"(?:{p})" for _, p in FORMS)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _long(x: Column) -> Column:
    return x.cast("bigint")


def _tens(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("bigint") for k in range(19)]), n + 1)


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of pairs (left, right), left < left_size and right < right_size: struct<l, r>."""

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        fixed = F.when(even, state["r"]).otherwise(state["l"])
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), fixed.cast("string")), 256)
        shift = _long(F.conv(F.substring(digest, 1, 14), 16, 10))
        return F.struct(F.when(even, (state["l"] + shift % left_size) % left_size).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise((state["r"] + shift % right_size) % right_size).alias("r"))

    start = F.struct(_long(left).alias("l"), _long(right).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _number(digits: Column, tweak: Column, key: str) -> Column:
    """A permutation of the digit strings of each length (2 to 20)."""
    n = F.length(digits)
    a = _long(F.floor(n / 2)).cast("int")
    b = n - a
    out = feistel(F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, b), _tens(a), _tens(b), F.concat(tweak, n.cast("string")), key)
    return F.transform(F.array(out), lambda s: F.concat(_pad(s["l"], a), _pad(s["r"], b)))[0]


def _digit(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = _digit(digits, i)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _refill(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in turn."""
    chars = F.sequence(F.lit(1), F.length(form))
    return F.array_join(F.transform(chars, lambda i: F.when(F.substring(form, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(F.substring(form, i, F.lit(1)))), "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` over a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _number(F.substring(d, F.lit(2), n - 2), F.lit("card"), key))
        whole = _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(n.between(13, 19) & (luhn_sum(d) % 10 == 0) & (d.rlike("[1-9]")), _let(whole, lambda w: _refill(m, w))).otherwise(m)

    return _let(_digits(m), of)


def _ipv4(m: Column, key: str) -> Column:
    def of(o: Column) -> Column:
        out = feistel(_long(o[0]) * 256 + _long(o[1]), _long(o[2]) * 256 + _long(o[3]), F.lit(65536), F.lit(65536), F.lit("ipv4"), key)
        text = F.transform(F.array(out), lambda s: F.concat_ws(".", *[x.cast("string") for x in (_long(F.floor(s["l"] / 256)), s["l"] % 256, _long(F.floor(s["r"] / 256)), s["r"] % 256)]))[0]
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), text).otherwise(m)

    return _let(F.split(m, r"\."), of)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike(r"^\d{4}-")
    day = F.coalesce(*[F.try_to_date(m, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")]) if hasattr(F, "try_to_date") else F.coalesce(*[F.to_date(F.try_to_timestamp(m, F.lit(f))) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")])

    def of(d: Column) -> Column:
        start = F.make_date(F.floor(F.year(d) / 100).cast("int") * 100, F.lit(1), F.lit(1))
        end = F.make_date(F.floor(F.year(d) / 100).cast("int") * 100 + 100, F.lit(1), F.lit(1))
        size, at = F.datediff(end, start), F.datediff(d, start)
        (la, lb), (sa, sb) = CENTURY[36525], CENTURY[36524]
        a, b = F.when(size == 36525, F.lit(la)).otherwise(F.lit(sa)), F.when(size == 36525, F.lit(lb)).otherwise(F.lit(sb))
        out = feistel(F.floor(at / b), at % b, a, b, F.concat(F.lit("date"), start.cast("string")), key)
        new = F.transform(F.array(out), lambda s: F.date_add(start, (s["l"] * b + s["r"]).cast("int")))[0]
        text = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(m.contains("."), F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
        return F.when(d.isNotNull() & (F.year(d) >= 1) & (F.year(d) < 9900), text).otherwise(m)

    return _let(day, of)


def _social(m: Column, key: str) -> Column:
    area, group, serial = (_long(F.substring(m, p, n)) for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("social"), key)
    text = F.transform(F.array(out), lambda s: F.concat_ws("-", _pad(s["l"] + 1 + (s["l"] >= 665).cast("int"), 3), _pad(_long(F.floor(s["r"] / 9999)) + 1, 2), _pad(s["r"] % 9999 + 1, 4)))[0]
    return F.when(valid, text).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = _digits(m)
    return _let(F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _number(F.substring(d, F.length(d) - 9, F.lit(10)), F.lit("phone"), key)), lambda w: _refill(m, w))


def _digest(m: Column, tweak: str, n: int, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), F.lit(str(n)), F.lower(m)), 256)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("p"), F.substring(_digest(m, "email", 0, key), 1, 16), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    new = F.substring(_digest(m, "secret", 0, key), F.lit(1), F.length(m))
    return F.when(F.upper(m) == m, F.upper(new)).otherwise(new)


_MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "secret": _secret, "date": _date, "ipv4": _ipv4, "social": _social, "card": _card, "phone": _phone}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """The pseudonym of one matched value; the value itself where it fails validation."""
    out = match
    for name, pattern in reversed(FORMS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), _MAKERS[name](match, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """struct<text, n_found>: the text with its validated personal data replaced, and how many values were."""
    found = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    between = F.split(text, _ANY)

    def rebuilt(state: Column) -> Column:
        new = F.transform(state["found"], lambda m: pseudonym(m, key))

        def joined(n: Column) -> Column:
            pieces = F.zip_with(state["between"], F.concat(n, F.array(F.lit(""))), lambda b, x: F.concat(b, x))
            changed = F.size(F.filter(F.zip_with(state["found"], n, lambda a, b: a != b), lambda x: x))
            return F.struct(F.array_join(pieces, "").alias("text"), changed.alias("n_found"))

        return F.when(F.size(state["found"]) == 0, F.struct(text.alias("text"), F.lit(0).alias("n_found"))).otherwise(_let(new, joined))

    whole = _let(F.struct(found.alias("found"), between.alias("between")), rebuilt)
    return F.when(text.rlike("[0-9@]"), whole).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n_found")))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with `text` replaced; its other columns stay."""
    return docs.withColumn("text", pseudonymised(F.col("text").cast("string"), key)["text"])
