"""Check digits of identifiers and canonical contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).cast("int")


def _weighted(c: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(c, i) * w
    return total


def _check_digit(rest: Column) -> Column:
    """11 less the remainder, 0 for ten and eleven."""
    return F.when(rest < 2, 0).otherwise(11 - rest)


def valid_cpf(c: Column) -> Column:
    """Eleven digits, not all equal, with two check digits modulo 11."""
    d = digits_of(c)
    first = _check_digit(_weighted(d, [*range(10, 1, -1)]) % 11)
    second = _check_digit(_weighted(d, [*range(11, 1, -1)]) % 11)
    shaped = d.rlike("^[0-9]{11}$") & ~d.rlike("^([0-9])\\1{10}$")
    return F.coalesce(F.when(shaped, (first == _digit(d, 9)) & (second == _digit(d, 10))).otherwise(False), F.lit(False))


def valid_nis(c: Column) -> Column:
    d = digits_of(c)
    check = _check_digit(_weighted(d, [3, 2, 9, 8, 7, 6, 5, 4, 3, 2]) % 11)
    return F.coalesce(F.when(d.rlike("^[0-9]{11}$"), check == _digit(d, 10)).otherwise(False), F.lit(False))


def valid_cns(c: Column) -> Column:
    """Fifteen digits as they are, nothing stripped. Beginning with 7, 8 or 9: their sum weighted by 15 to 1 is divisible by 11. With 1 or 2:
    eleven digits of another number, then 000 and the check digit of their weighted sum, or 001 and that of the sum plus 2 where it would be ten."""
    total, base = _weighted(c, [*range(15, 0, -1)]), _weighted(c, [*range(15, 4, -1)])
    check = 11 - base % 11
    tail = F.when(check == 11, "0000").when(check == 10, F.concat(F.lit("001"), (11 - (base + 2) % 11).cast("string"))).otherwise(F.concat(F.lit("000"), check.cast("string")))
    return F.when(c.rlike("^[789][0-9]{14}$"), total % 11 == 0).when(c.rlike("^[12][0-9]{14}$"), F.substring(c, 12, 4) == tail).otherwise(False)


ENVELOPE = "[ \\t\\r\\n\\u00A0]"


def _unwrapped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{ENVELOPE}+|{ENVELOPE}+$", "")


def phone_br(c: Column) -> Column:
    """+ or 00 and 8 to 15 digits behind a 00 among them; else 10 or 11 digits get 55, and 12 or 13 that begin with 55 stay; else null."""
    raw = _unwrapped(c)
    d = digits_of(raw)
    foreign = raw.startswith("+") | raw.startswith("00")
    bare = F.regexp_replace(d, "^00", "")
    return F.when(foreign & bare.rlike("^[0-9]{8,15}$"), bare).when(foreign, None).when(F.length(d).isin(10, 11), F.concat(F.lit("55"), d)).when(F.length(d).isin(12, 13) & d.startswith("55"), d)


def phone_digits_v1(c: Column) -> Column:
    """The earlier form of phones, for replays: digits alone; none gives null."""
    return F.nullif(digits_of(c), F.lit(""))


def attribute_instance_key(cardinality: Column, kind: Column, value: Column) -> Column:
    """# for a single attribute; the canonical phone or e-mail for one that a person may have several of; null where it is invalid."""
    return F.when(cardinality == "SINGLE", "#").when(kind == "TELEFONE", phone_br(value)).when(kind == "EMAIL", email_canonical(value))


def email_canonical(c: Column) -> Column:
    """One @ inside, at most 512 characters; A-Z lower-cased and nothing else."""
    raw = _unwrapped(c)
    lowered = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(raw.rlike("^[^@]+@[^@]+$") & (F.length(raw) <= 512), lowered)
