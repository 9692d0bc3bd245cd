"""Three-valued eligibility rules compiled to columns, and their impact between versions.

Facts are text columns. A blank fact is missing. Numbers are decimals with a point, and thousands may be set off by commas; dates are yyyy-MM-dd. A
fact that a comparison can't read is an error, unless unreadable="missing" makes it a missing one.
"""

from __future__ import annotations

import datetime
import decimal
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import SPACE

#: Operators, results and reasons.
PRESENT, ABSENT, EQUAL, DIFFERENT, IN = "PRESENTE", "AUSENTE", "IGUAL", "DIFERENTE", "EM"
NUMBERS, DATES = ("NUMERO_MAIOR_IGUAL", "NUMERO_MENOR_IGUAL"), ("DATA_MAIOR_IGUAL", "DATA_MENOR_IGUAL")
YES, NO, UNSURE = "COMPATIVEL", "NAO_COMPATIVEL", "NAO_AVALIAVEL"
NUMBER = "^\\s*[-+]?(\\d[\\d,]*\\.?\\d*|\\.\\d+)\\s*$"


@dataclass(frozen=True)
class Condition:
    fact: str
    operator: str
    expected: str | None = None
    any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    nature: str
    code: str
    version: int
    implementation: str
    all_of: tuple[Condition, ...] = ()
    any_of: tuple[Condition, ...] = ()
    valid_for: datetime.timedelta | None = None


def number_of(text: str) -> decimal.Decimal | None:
    return decimal.Decimal(re.sub(r"[,\s]", "", text)) if re.match(NUMBER, text) else None


def problems_of(rule: Rule) -> list[str]:
    """What keeps a rule from being published."""
    out = []
    conditions = [*rule.all_of, *rule.any_of]
    checks = [
        (rule.nature in ("BENEFICIO", "SERVICO"), "nature"), (re.fullmatch("[A-Z0-9]{4}", rule.code) is not None, "code"), (rule.version > 0, "version"), (0 < len(rule.implementation.strip()) <= len(rule.implementation) <= 80, "implementation"),
        (bool(conditions), "no condition"), (rule.valid_for is None or rule.valid_for > datetime.timedelta(0), "valid_for"), (len(set(conditions)) == len(conditions), "repeated condition"), (all(c.fact.strip() for c in conditions), "fact"),
    ]
    out += [name for held, name in checks if not held]
    for c in conditions:
        if c.operator not in (PRESENT, ABSENT, EQUAL, DIFFERENT, IN, *NUMBERS, *DATES):
            out.append(f"{c.fact}: operator")
        if c.operator in (EQUAL, DIFFERENT, *NUMBERS, *DATES) and c.expected is None:
            out.append(f"{c.fact}: expected")
        if (c.operator == IN) != bool(c.any_of):
            out.append(f"{c.fact}: any_of")
    return out


def held(c: Condition, unreadable: str) -> Column:
    """True, false, or null where the fact is missing."""
    text = F.col(c.fact).cast("string")
    there = F.coalesce(~text.rlike(f"^{SPACE}*$"), F.lit(False))
    if c.operator == PRESENT:
        return there
    if c.operator == ABSENT:
        return ~there
    if c.operator in (EQUAL, DIFFERENT, IN):
        same = text.isin(list(c.any_of)) if c.operator == IN else text == c.expected
        return F.when(there, ~same if c.operator == DIFFERENT else same)
    if c.operator in NUMBERS:
        value, expected = F.when(text.rlike(NUMBER), F.regexp_replace(text, "[,\\s]", "").cast("decimal(38,10)")), number_of(c.expected)
        limit = None if expected is None else F.lit(str(expected)).cast("decimal(38,10)")
    else:
        value, limit = F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")), F.lit(datetime.date.fromisoformat(c.expected))
    if limit is None:
        raise ValueError(f"{c.fact}: {c.expected} is no number")
    wrong = F.lit(None).cast("boolean") if unreadable == "missing" else F.raise_error(F.concat(F.lit(f"{c.operator} of {c.fact} can't read: "), text)).cast("boolean")
    return F.when(there, F.when(value.isNull(), wrong).otherwise(value >= limit if c.operator.endswith("MAIOR_IGUAL") else value <= limit))


def evaluate(rule: Rule, at: Column | None = None, unreadable: str = "raise") -> Column:
    """struct(result, reason, valid_until). Conditions of all_of in order: the first missing or false one decides; then one of any_of
    must hold, and with none true a missing one leaves the rule undecided. A rule that isn't fit for publication is an error."""
    if wrong := problems_of(rule):
        raise ValueError(", ".join(wrong))
    until = F.lit(None).cast("timestamp") if at is None or rule.valid_for is None else at + F.lit(rule.valid_for)
    row = lambda result, reason, limit=None: F.struct(F.lit(result).alias("result"), F.lit(reason).alias("reason"), (F.lit(None).cast("timestamp") if limit is None else limit.cast("timestamp")).alias("valid_until"))
    out = row(YES, "REGRA_VERSIONADA_ATENDIDA", until)
    if rule.any_of:
        each = [held(c, unreadable) for c in rule.any_of]
        out = F.when(F.coalesce(*(F.when(h, True) for h in each), F.lit(False)), out).when(F.coalesce(*(F.when(h.isNull(), True) for h in each), F.lit(False)), row(UNSURE, "DADOS_INSUFICIENTES_ANYOF")).otherwise(row(NO, "NENHUMA_CONDICAO_ANYOF_ATENDIDA"))
    for c in reversed(rule.all_of):
        h = held(c, unreadable)
        out = F.when(h.isNull(), row(UNSURE, f"DADO_AUSENTE:{c.fact}")).when(~h, row(NO, f"REGRA_NAO_ATENDIDA:{c.fact}:{c.operator}")).otherwise(out)
    return out


def impact(df: DataFrame, before: Rule, after: Rule, unreadable: str = "raise") -> DataFrame:
    """One row: population, current and candidate compatible, entered, exited, and those that neither version can evaluate."""
    if (before.nature, before.code) != (after.nature, after.code):
        raise ValueError("versions of different rules")
    d = df.select(evaluate(before, None, unreadable).result.alias("b"), evaluate(after, None, unreadable).result.alias("a"))
    n = lambda c: F.count_if(F.expr(c))
    return d.agg(
        F.count("*").alias("population"), n(f"b = '{YES}'").alias("current_compatible"), n(f"a = '{YES}'").alias("candidate_compatible"), n(f"b <> '{YES}' and a = '{YES}'").alias("entered"),
        n(f"b = '{YES}' and a <> '{YES}'").alias("exited"), n(f"b = '{UNSURE}'").alias("current_not_evaluable"), n(f"a = '{UNSURE}'").alias("candidate_not_evaluable"),
    )
