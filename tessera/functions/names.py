"""Person names: normalisation, phonetics, similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Particles that carry no identity.
PARTICLES = ["DA", "DAS", "DE", "DO", "DOS"]
#: Similarity classes.
HIGH, MEDIUM = 0.92, 0.80


#: Code points that Unicode calls white space, as a class of a regular expression.
SPACE = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _bare(c: str) -> str:
    """Canonical decomposition without non-spacing marks, recomposed."""
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"))


@lru_cache(maxsize=1)
def _marked() -> tuple[str, str]:
    """Characters of the basic plane that are one other character when marks are dropped, and those, from Unicode itself."""
    pairs = [(c, b) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0xFFFE)]) if (b := _bare(c)) != c and len(b) == 1]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=1)
def _kept_by_upper() -> tuple[str, str]:
    """Characters that a simple upper case leaves alone and a full one writes as several, and dotless i; and stand-ins of private use."""
    kept = [c for c in map(chr, range(0x80, 0xFFFE)) if not 0xD800 <= ord(c) < 0xE100 and (len(c.upper()) > 1 or c == "\u0131")]
    return "".join(kept), "".join(chr(0xE000 + i) for i in range(len(kept)))


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_marked()), "\\p{Mn}+", "")


def upper_simple(c: Column) -> Column:
    """Upper case one character for one: ß stays."""
    kept, standing = _kept_by_upper()
    return F.translate(F.upper(F.translate(c, kept, standing)), standing, kept)


def collapse(c: Column) -> Column:
    """Without white space at the ends and with single spaces inside; blank gives null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, SPACE + "+", " "), "^ | $", ""), F.lit(""))


def normalize_text(c: Column) -> Column:
    """Without marks, upper case, trimmed, single spaces; blank gives null. JVM only, for the basic plane of Unicode."""
    return collapse(upper_simple(strip_marks(c)))


def without_particles(bare: Column) -> Column:
    """An upper-case name without marks, less its particles; one of particles alone stays."""
    content = F.filter(F.split(bare, " "), lambda t: ~t.isin(PARTICLES))
    return F.when(F.size(content) > 0, F.array_join(content, " ")).otherwise(bare)


@F.pandas_udf(StringType())
def normalize_text_exact(s: pd.Series) -> pd.Series:
    """The same for all of Unicode, of distinct values in Python."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        upper = "".join(c if len(c.upper()) > 1 or c == "\u0131" else c.upper() for c in _bare(x))
        return " ".join(upper.split()) or None

    codes, values = pd.factorize(s)
    found = pd.Series([one(v) for v in values], dtype=object)
    return found.reindex(codes).where(codes >= 0, None).reset_index(drop=True)


def content_tokens(normalized: Column) -> Column:
    """Tokens that are no particle; all of them where there are only particles."""
    tokens = F.split(normalized, " ")
    content = F.filter(tokens, lambda t: ~t.isin(PARTICLES))
    return F.when(F.size(content) > 0, content).otherwise(tokens)


def first_name(normalized: Column) -> Column:
    return F.element_at(content_tokens(normalized), 1)


def last_surname(normalized: Column) -> Column:
    tokens = content_tokens(normalized)
    return F.when(F.size(tokens) > 1, F.element_at(tokens, -1))


#: Rewrites of a Portuguese phonetic code, in the order in which they apply.
PHONETIC_RULES = [
    ("\\bH", ""), ("LH", "1"), ("NH", "3"), ("CH", "X"), ("SH", "X"), ("SCH", "X"), ("PH", "F"), ("SC(?=[EI])", "S"), ("SC(?=[AOU])", "SK"), ("QU(?=[EI])", "K"), ("QU", "K"),
    ("C(?=[EI])", "S"), ("C(?![EIH])", "K"), ("C", "K"), ("G(?=[EI])", "J"), ("Q", "K"), ("W", "V"), ("Y", "I"), ("Z", "S"), ("N\\b", "M"), ("([AEIOU])\\1+", "$1"), ("(\\w)\\1+", "$1"),
]


def phonetic(c: Column) -> Column:
    """The phonetic code of a name: marks and all but letters and spaces fall first; blank gives null."""
    return phonetic_of_bare(upper_simple(strip_marks(c)))


def phonetic_of_bare(upper: Column) -> Column:
    """The same of an upper-case name without marks."""
    out = collapse(F.regexp_replace(upper, "[^A-Z ]+", ""))
    for pattern, to in PHONETIC_RULES:
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


#: Particles, suffixes of kinship (and what their abbreviations stand for) and titles of Brazilian names.
NAME_PARTICLES = ["DA", "DAS", "DE", "DO", "DOS", "DI", "DU", "DEL", "D"]
KINSHIP = {
    "FILHO": "FILHO", "FILHA": "FILHA", "FL": "FILHO", "JUNIOR": "JUNIOR", "JR": "JUNIOR", "NETO": "NETO", "NETA": "NETA", "BISNETO": "BISNETO", "BISNETA": "BISNETA",
    "SOBRINHO": "SOBRINHO", "SOBRINHA": "SOBRINHA", "SEGUNDO": "SEGUNDO", "SEGUNDA": "SEGUNDA", "TERCEIRO": "TERCEIRO", "TERCEIRA": "TERCEIRA",
}
TITLES = ["DR", "DRA", "DOUTOR", "DOUTORA", "SGTO", "SARGENTO", "TENENTE", "MAJOR", "CAPITAO", "CORONEL", "GENERAL", "GOVERNADOR", "GOVERNADORA"]


def staged(df: DataFrame, **steps: Column) -> DataFrame:
    """df plus columns, behind a generator: the optimizer would put chains of expressions into one another, once for each use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in steps.items())))))


def with_name_parts(df: DataFrame, c: str, out: str) -> DataFrame:
    """df plus struct(full, kinship, last_surname, title, repeated_particle, first) of a name column; null for a blank name.

    A title is a first token before two others; a kinship suffix is a last token behind two content tokens; the last surname is the
    last content token when there are two. Tokens are read without . and , at their ends; full keeps them.
    """
    col = F.col
    is_content = lambda w, i, of: ~w.isin(NAME_PARTICLES) & ~(w.isin("LA", "LAS", "LOS") & F.coalesce((i > 0) & (F.get(of, i - 1) == "DE"), F.lit(False)))
    content = lambda of: F.filter(of, lambda w, i: is_content(w, i, of))
    d = staged(df, _full=normalize_text(col(c)))
    d = staged(d, _words=F.transform(F.split("_full", " "), lambda t: F.btrim(t, F.lit(".,"))))
    d = staged(d, _title=F.when((F.size("_words") > 2) & F.get("_words", F.lit(0)).isin(TITLES), F.get("_words", F.lit(0))))
    d = staged(d, _body=F.when(col("_title").isNotNull(), F.slice("_words", 2, F.size("_words"))).otherwise(col("_words")))
    d = staged(d, _all=content(col("_body")), _rest=F.slice("_body", 1, F.greatest(F.size("_body") - 1, F.lit(0))))
    kinship = F.element_at(F.create_map(*(F.lit(x) for kv in KINSHIP.items() for x in kv)), F.element_at("_body", -1))
    d = staged(d, _kinship=F.when((F.size(content(col("_rest"))) >= 2) & F.element_at("_body", -1).isin(list(KINSHIP)), kinship))
    cut = col("_kinship").isNotNull()
    d = staged(d, _kept=F.when(cut, F.slice("_all", 1, F.size("_all") - 1)).otherwise(col("_all")), _named=F.when(cut, col("_rest")).otherwise(col("_body")))
    repeated = F.exists(F.transform("_named", lambda w, i: F.coalesce((i > 0) & w.isin(NAME_PARTICLES) & (F.get("_named", i - 1) == w), F.lit(False))), lambda x: x)
    last = F.when(F.size("_kept") >= 2, F.element_at("_kept", -1))
    parts = F.struct(col("_full").alias("full"), col("_kinship").alias("kinship"), last.alias("last_surname"), col("_title").alias("title"), repeated.alias("repeated_particle"), F.nullif(F.get("_body", F.lit(0)), F.lit("")).alias("first"))
    return staged(d, **{out: F.when(col("_full").isNotNull(), parts)}).select(*df.columns, out)


def jaro_winkler_of(a: str, b: str, gate: float = 0.0) -> float:
    """Jaro similarity, raised by the common prefix (up to 4, a tenth each) where it is over gate."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    m = len(hits)
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(len(b)) if taken[j]), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > gate else jaro


def _of_pairs(a: pd.Series, b: pd.Series, gate: float) -> pd.Series:
    """Similarities, each distinct pair of a batch once; null with a null side."""
    known: dict[tuple[str, str], float] = {}
    out: list[float | None] = []
    for pair in zip(a, b, strict=True):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = jaro_winkler_of(*pair, gate)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(a, b, 0.0)


@F.pandas_udf(DoubleType())
def jaro_winkler_gated(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_pairs(a, b, 0.7)


@F.pandas_udf(DoubleType())
def guarded_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The whole names' similarity, or the weakest of their content tokens one by one where both have the same number of them, over one."""

    def tokens(x: str) -> list[str]:
        return [t for t in x.split(" ") if t and t not in PARTICLES]

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        s, p, q = jaro_winkler_of(x, y), tokens(x), tokens(y)
        return min([s, *(jaro_winkler_of(i, j) for i, j in zip(p, q, strict=True))]) if len(p) == len(q) > 1 and x != y else s

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_class(a: Column, b: Column, similarity: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "LOW").when(a == b, "EXACT").when(similarity >= HIGH, "HIGH").when(similarity >= MEDIUM, "MEDIUM").otherwise("LOW")


def abbreviation_compatible(a: Column, b: Column) -> Column:
    """Content tokens (without particles) equal one by one, or one the other's initial (with or without a dot), with at least one initial."""
    content = lambda c: F.transform(F.filter(F.split(c, " "), lambda t: ~t.isin(PARTICLES)), lambda t: F.when(t.rlike("^.\\.$"), F.substring(t, 1, 1)).otherwise(t))
    x, y = content(a), content(b)
    initial = lambda p, q: p.rlike("^\\p{L}$") & (F.length(q) > 1) & q.startswith(p)
    fits = F.zip_with(x, y, lambda p, q: F.when(p == q, 0).when(initial(p, q) | initial(q, p), 1).otherwise(2))
    return F.coalesce((a != b) & (F.size(x) == F.size(y)) & (F.size(x) > 0) & F.forall(fits, lambda v: v < 2) & F.exists(fits, lambda v: v == 1), F.lit(False))


#: Exclusive levels of two names, the first that holds.
NOMINAL_LEVELS = ["Missing", "ExactFull", "ExactFirstLast", "ReversedFirstLast", "HighFull", "HighFirstLast", "ExactLast", "ExactFirst", "Other"]


def nominal_level(a: Column, b: Column, whole: Column, firsts: Column, lasts: Column) -> Column:
    """The level of two name_parts(); whole, firsts, lasts: similarities of the full names, first names and last surnames."""
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    first, last = same(a.first, b.first), same(a.last_surname, b.last_surname)
    return (
        F.when(a.isNull() | b.isNull(), "Missing").when(a.full == b.full, "ExactFull").when(first & last, "ExactFirstLast")
        .when(same(a.first, b.last_surname) & same(a.last_surname, b.first) & ~same(a.first, a.last_surname), "ReversedFirstLast").when(whole >= HIGH, "HighFull")
        .when(F.coalesce((firsts >= HIGH) & (lasts >= HIGH), F.lit(False)), "HighFirstLast").when(last, "ExactLast").when(first, "ExactFirst").otherwise("Other")
    )


def with_nominal_level(pairs: DataFrame, left: str, right: str, out: str = "level") -> DataFrame:
    """pairs plus the level of two name columns; each distinct pair of names is compared once."""
    names = with_name_parts(with_name_parts(pairs.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct(), "_l", "_a"), "_r", "_b")
    similar = names.select("_l", "_r", "_a", "_b", jaro_winkler("_a.full", "_b.full").alias("_w"), jaro_winkler("_a.first", "_b.first").alias("_f"), jaro_winkler("_a.last_surname", "_b.last_surname").alias("_s"))
    levels = similar.select("_l", "_r", nominal_level(F.col("_a"), F.col("_b"), F.col("_w"), F.col("_f"), F.col("_s")).alias(out))
    return pairs.join(levels, F.col(left).eqNullSafe(F.col("_l")) & F.col(right).eqNullSafe(F.col("_r")), "left").drop("_l", "_r")
