"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in column expressions.

Validated card numbers, phone numbers, social security numbers, network addresses, dates and e-mail
names are permuted within their format under a key: equal values get equal pseudonyms in every
document, different values different ones, and without the key nothing leads back. Card numbers stay
valid by their check digit, dates stay dates.

Everything is evaluated in the row: one pattern cuts a text into pieces and finds, finds are replaced,
and the pieces are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import documents

ROUNDS = 10
EMAIL = "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)*\\.\\p{L}{2,}"
ADDRESS = "(?<![\\d.])\\d{1,3}(?:\\.\\d{1,3}){3}(?![\\d]|\\.\\d)"
DATE = "(?<![\\d/.-])(?:\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{2}\\.\\d{2}\\.\\d{4})(?![\\d/-])"
SOCIAL = "(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"
CARD = (
    "(?<![\\p{L}\\d])(?:\\d{13,19}|\\d{4}-\\d{4}-\\d{4}-\\d{4}|\\d{4} \\d{4} \\d{4} \\d{4}|\\d{4}[ -]\\d{6}[ -]\\d{5})(?![\\p{L}\\d])"
)
PHONE = (
    "\\+1[ .-]?\\(?\\d{3}\\)?[ .-]?\\d{3}[ .-]?\\d{4}(?!\\d)"
    "|\\+[2-9]\\d{0,2}[ .-]?\\(?\\d{1,4}\\)?(?:[ .-]?\\d{2,4}){2,3}(?!\\d)"
    "|(?<!\\d)\\(\\d{3}\\) ?\\d{3}-\\d{4}(?!\\d)|(?<![\\d.-])\\d{3}([.-])\\d{3}\\1\\d{4}(?![\\d-])"
)
KINDS = ("email", "date", "address", "social", "card", "phone")
ANY = "|".join((EMAIL, DATE, ADDRESS, SOCIAL, CARD, PHONE))

# 400 years have 146,097 days, again and again: 189 x 773.
FIRST_DAY, DAY_GRID = "1800-01-01", (189, 773)


def _keystream(key: str, tweak: Column, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn, other), 256)


def _byte(stream: Column, place: Column) -> Column:
    return F.conv(F.substr(stream, place % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shifted(text: Column, stream: Column) -> Column:
    """Letters a-z, A-Z and digits moved on within their class; other characters stay."""

    def moved(char: Column, place: Column) -> Column:
        code, by = F.ascii(char), _byte(stream, place)
        out = F.when(char.between("a", "z"), F.char((code - 97 + by) % 26 + 97))
        out = out.when(char.between("A", "Z"), F.char((code - 65 + by) % 26 + 65))
        return out.when(char.between("0", "9"), F.char((code - 48 + by) % 10 + 48)).otherwise(char)

    return F.array_join(F.transform(F.split(text, ""), moved), "")


def permuted_text(text: Column, tweak: Column, key: str) -> Column:
    """Feistel network on the two halves of a text, each turn shifting one by a hash of the other."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), half).alias("left"), F.substr(text, half + 1, F.length(text) - half).alias("right")
    )
    tweak = F.concat_ws("|", tweak, F.length(text).cast("string"))

    def turn(state: Column, r: Column) -> Column:
        number = r.cast("string")
        even = r % 2 == 0
        left = F.when(even, _shifted(state["left"], _keystream(key, tweak, number, state["right"])))
        right = F.when(~even, _shifted(state["right"], _keystream(key, tweak, number, state["left"])))
        return F.struct(left.otherwise(state["left"]).alias("left"), right.otherwise(state["right"]).alias("right"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["left"], s["right"])
    )


def permuted_number(number: Column, high: int, low: int, tweak: str, key: str) -> Column:
    """Feistel network on 0 .. high * low - 1, whose two digits (of bases ``high`` and ``low``) shift each other."""
    start = F.struct(F.floor(number / low).cast("bigint").alias("high"), (number % low).cast("bigint").alias("low"))

    def hashed(r: Column, other: Column) -> Column:
        stream = _keystream(key, F.lit(tweak), r.cast("string"), other.cast("string"))
        return F.conv(F.substr(stream, F.lit(1), F.lit(12)), 16, 10).cast("bigint")

    def turn(state: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_high = F.when(even, (state["high"] + hashed(r, state["low"])) % high).otherwise(state["high"])
        new_low = F.when(~even, (state["low"] + hashed(r, state["high"])) % low).otherwise(state["low"])
        return F.struct(new_high.alias("high"), new_low.alias("low"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["high"] * low + s["low"]
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _placed(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced one by one by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(state: Column, char: Column) -> Column:
        is_digit = char.between("0", "9")
        out = F.concat(state["out"], F.when(is_digit, F.substr(digits, state["next"], F.lit(1))).otherwise(char))
        return F.struct(out.alias("out"), (state["next"] + is_digit.cast("int")).alias("next"))

    return F.aggregate(F.split(form, ""), start, put, lambda s: s["out"])


def _check_sum(digits: Column) -> Column:
    """Luhn sum of digits in front of a check digit."""

    def add(total: Column, char: Column) -> Column:
        # Digits come from the right; every other one counts twice, from the first on.
        value = F.ascii(char) - 48
        twice = value * 2 - F.when(value > 4, 9).otherwise(0)
        return F.struct(
            (total["sum"] + F.when(total["even"], twice).otherwise(value)).alias("sum"), (~total["even"]).alias("even")
        )

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("even"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda s: s["sum"])


def _card(found: Column, key: str) -> Column:
    digits = _digits(found)
    body, check = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    new = permuted_text(body, F.lit("card"), key)
    # Not in a lambda of its own: the body is computed once for the digits and once for their check digit.
    last = (10 - _check_sum(new) % 10) % 10
    valid = (_check_sum(body) + check) % 10 == 0
    return F.when(valid & (F.length(F.replace(digits, F.lit("0"), F.lit(""))) > 0), _placed(found, F.concat(new, last.cast("string"))))


def _phone(found: Column, key: str) -> Column:
    digits = _digits(found)
    n = F.length(digits)
    kept = F.greatest(n - 10, F.when(found.startswith("+"), 1).otherwise(0))
    new = permuted_text(F.substr(digits, kept + 1, n - kept), F.lit("phone"), key)
    return F.when(n.between(7, 15), _placed(found, F.concat(F.substr(digits, F.lit(1), kept), new)))


def _social(found: Column, key: str) -> Column:
    valid = ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, _placed(found, permuted_text(_digits(found), F.lit("social"), key)))


def _address(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, "\\."), lambda p: p.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, p: total * 256 + p)
    new = permuted_number(number, 1 << 16, 1 << 16, "address", key)
    octets = F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda by: F.pmod(F.floor(new / F.pow(F.lit(2), by)), F.lit(256)).cast("bigint").cast("string"))
    return F.when(F.forall(parts, lambda p: p <= 255), F.array_join(octets, "."))


def _date(found: Column, key: str) -> Column:
    out = None
    high, low = DAY_GRID
    for form, pattern in (("yyyy-MM-dd", "-"), ("dd/MM/yyyy", "/"), ("dd.MM.yyyy", ".")):
        day = F.datediff(F.try_to_date(found, form), F.lit(FIRST_DAY).cast("date"))
        new = permuted_number(day, high, low, "date", key)
        moved = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), form)
        value = F.when(day.between(0, high * low - 1), moved)
        out = F.when(found.contains(pattern), value) if out is None else out.when(found.contains(pattern), value)
    return out


def _email(found: Column, key: str) -> Column:
    name, host = F.substring_index(found, "@", 1), F.substring_index(found, "@", -1)
    return F.concat(permuted_text(name, F.lit("email"), key), F.lit("@"), host)


def kind_of(found: Column) -> Column:
    """Which format a find has."""
    kind = F.when(found.contains("@"), "email")
    for name, pattern in (("date", DATE), ("address", ADDRESS), ("social", SOCIAL), ("card", CARD)):
        kind = kind.when(found.rlike(f"^(?:{pattern})$"), name)
    return kind.otherwise("phone")


def pseudonym(found: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a find; null where it is no valid value of its kind."""
    ways = {"email": _email, "date": _date, "address": _address, "social": _social, "card": _card, "phone": _phone}
    out = None
    for name in KINDS:
        value = ways[name](found, key)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_found, n_email, n_date, n_address, n_social, n_card, n_phone, text) per row of ``docs`` (doc_id, text).

    ``text`` has every valid value replaced; ``n_found`` counts them. Finds that fail their validation stay. A
    null text stays null and an empty one empty, with counts of zero; a null id is carried; repeated rows
    come out alike. Keep ``key`` secret, and the same for all runs whose results are to be linked.
    """
    rows = documents(docs, "doc_id", "text")
    any_digit = F.col("text").rlike("[0-9@]")
    rows = rows.withColumn("_found", F.when(any_digit, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    some = F.size(F.coalesce("_found", F.array().cast("array<string>"))) > 0
    kinds = F.transform("_found", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    rows = rows.withColumn("_kinds", F.when(some, kinds))
    new = F.transform("_kinds", lambda m: F.struct(pseudonym(m["value"], m["kind"], key).alias("new"), m["value"].alias("old"), m["kind"].alias("kind")))
    rows = rows.withColumn("_new", new)
    inside = F.concat(F.transform("_new", lambda m: F.coalesce(m["new"], m["old"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split("text", ANY, -1), inside, lambda a, b: F.concat(a, b)), "")

    def count(kind: str) -> Column:
        hits = F.filter("_new", lambda m: m["new"].isNotNull() & (m["kind"] == kind))
        return F.when(F.col("_new").isNull(), 0).otherwise(F.size(hits)).cast("bigint")

    total = F.when(F.col("_new").isNull(), 0).otherwise(F.size(F.filter("_new", lambda m: m["new"].isNotNull())))
    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(joined)
    return rows.select(
        "doc_id", total.cast("bigint").alias("n_found"), *[count(k).alias(f"n_{k}") for k in KINDS], text.alias("text")
    )
