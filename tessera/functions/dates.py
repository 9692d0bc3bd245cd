"""Birth-date evidence, birth blocking plans and calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(c: Column, places: int) -> list[Column]:
    return [F.floor(c / 10**k) % 10 for k in range(places)]


def digit_distance(a: Column, b: Column) -> Column:
    """Places in which ddMMyyyy differ."""
    x, y = (sum((_digits(f(c), n) for f, n in ((F.dayofmonth, 2), (F.month, 2), (F.year, 4))), []) for c in (a, b))
    return sum((F.when(p != q, 1).otherwise(0) for p, q in zip(x, y, strict=True)), F.lit(0))


def equal_parts(a: Column, b: Column) -> Column:
    return sum((F.when(f(a) == f(b), 1).otherwise(0) for f in (F.dayofmonth, F.month, F.year)), F.lit(0))


def _evidence(a: Column, b: Column, d: Column, parts: Column) -> Column:
    swapped = (F.dayofmonth(a) == F.month(b)) & (F.month(a) == F.dayofmonth(b)) & (F.year(a) == F.year(b))
    century = (F.dayofmonth(a) == F.dayofmonth(b)) & (F.month(a) == F.month(b)) & (F.abs(F.year(a) - F.year(b)) == 100)
    return (
        F.when(a.isNull() | b.isNull(), None).when(a == b, "EXACT").when(swapped, "DAY_MONTH_SWAP").when(century, "CENTURY_SHIFT").when(d == 1, "ONE_DIGIT_ERROR")
        .when(parts >= 2, "PARTIAL_2").when(d == 2, "TWO_DIGIT_ERROR").when(parts == 1, "PARTIAL_1").otherwise("OTHER")
    )


def birth_evidence(a: Column, b: Column) -> Column:
    """The first that holds, from equality to other; null where a date is missing."""
    return _evidence(a, b, digit_distance(a, b), equal_parts(a, b))


def birth_evidence_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(evidence, mask, n) of pairs of dates: equal pairs are counted first, and what is left is judged once each, distances once."""
    counted = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    once = counted.select("n", F.inline(F.array(F.struct("a", "b", digit_distance(F.col("a"), F.col("b")).alias("d"), equal_parts(F.col("a"), F.col("b")).alias("parts")))))
    return once.groupBy(_evidence(F.col("a"), F.col("b"), F.col("d"), F.col("parts")).alias("evidence"), joint_mask(F.col("a"), F.col("b")).alias("mask")).agg(F.sum("n").alias("n"))


def joint_mask(a: Column, b: Column) -> Column:
    """Bit 0: day, bit 1: month, bit 2: year are equal."""
    return sum((F.when(f(a) == f(b), 1 << i).otherwise(0) for i, f in enumerate((F.dayofmonth, F.month, F.year))), F.lit(0))


def ageing_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0-30_DIAS").when(days <= 90, "31-90_DIAS").when(days <= 180, "91-180_DIAS").when(days <= 365, "181-365_DIAS").otherwise("365+_DIAS")


def lateness_status(days: Column, allowed: Column) -> Column:
    """days from the milestone to the receipt, null without a milestone."""
    return F.when(days.isNull(), "SEM_MARCO").when(days < 0, "DATA_FUTURA").when(days > allowed, "EM_ATRASO").otherwise("NO_PRAZO")


def lateness_band(days: Column, allowed: Column) -> Column:
    late = days - allowed
    return F.when(days.isNull(), "SEM_MARCO").when(days < 0, "DATA_FUTURA").when(late <= 0, "NO_PRAZO").when(late <= 3, "1-3_DIAS").when(late <= 7, "4-7_DIAS").when(late <= 30, "8-30_DIAS").otherwise("31+_DIAS")


#: Passes of birth blocking in their order, by bit.
BIRTH_PASSES = ["ExactDate", "MonthYearWithInitial", "DayYearWithInitial", "TransposedDayMonth", "NeighborYear"]


def initial(name: Column) -> Column:
    return F.upper(F.substring(F.regexp_replace(name, "^\\s+", ""), 1, 1))


def birth_keys(date: Column, name: Column, mother: Column, tolerance: int, seeking: bool) -> Column:
    """array<struct<pass int, key string>>: two dates meet in a pass when they share a key of it, so that passes are equi-joins.

    seeking: the side that looks for candidates generates the transposed and the neighbouring dates; the other gives its own date.
    Passes with initials take those of the name and of the mother's name, each a key of its own.
    """
    if not 0 <= tolerance <= 2:
        raise ValueError(f"tolerance {tolerance} is not in 0 to 2")
    text = date.cast("string")
    entry = lambda i, key: F.struct(F.lit(i).alias("pass"), key.alias("key"))
    made = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")).cast("date").cast("string")
    swapped = made(F.year(date), F.dayofmonth(date), F.month(date))
    keys = [entry(0, text)]
    for who, who_name in (("N", name), ("M", mother)):
        letter = F.nullif(initial(who_name), F.lit(""))
        keys.append(entry(1, F.when(letter.isNotNull(), F.concat(F.lit(f"{who}|"), letter, F.lit("|"), F.date_format(date, "yyyy-MM")))))
        keys.append(entry(2, F.when(letter.isNotNull(), F.concat(F.lit(f"{who}|"), letter, F.lit("|"), F.date_format(date, "yyyy-dd")))))
    keys.append(entry(3, F.when(swapped != text, swapped) if seeking else text))
    for offset in range(-tolerance, tolerance + 1) if seeking else [0]:
        if offset or not seeking:
            keys.append(entry(4, made(F.year(date) + offset, F.month(date), F.dayofmonth(date)) if seeking else text))
    return F.filter(F.array(*keys), lambda k: k.key.isNotNull())


def birth_candidates(left: DataFrame, right: DataFrame, tolerance: int = 1) -> DataFrame:
    """(left_id, right_id, passes, first_pass) of rows (id, birth, name, mother) that meet in a birth pass; passes: a mask by BIRTH_PASSES."""
    side = lambda d, s, seeking: d.where("birth is not null").select(F.col("id").alias(f"{s}_id"), F.explode(birth_keys(F.col("birth"), F.col("name"), F.col("mother"), tolerance, seeking)).alias("k")).select(f"{s}_id", "k.*")
    met = side(left, "left", True).join(side(right, "right", False), ["pass", "key"]).groupBy("left_id", "right_id").agg(F.bit_or(F.expr("shiftleft(1, pass)")).alias("passes"), F.min("pass").alias("_first"))
    return met.select("left_id", "right_id", "passes", F.element_at(F.array(*map(F.lit, BIRTH_PASSES)), F.col("_first") + 1).alias("first_pass"))
