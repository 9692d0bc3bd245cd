"""Digests: of UTF-16 text, keyed, of canonical JSON, and fingerprints of settings."""

from __future__ import annotations

import decimal
import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What does not make a new version of a person: technical properties, at the root and at any depth, and lists without order.
PERSON_ROOT, PERSON_ANYWHERE = ["codigoPessoaOrigem", "sourceTransactionId"], ["atualizadoEmOrigem"]
PERSON_SETS = ["atributosTransversais", "conferenciasDocumentais", "evidenciasDocumentais", "valores"]
BLOCK = 64


def sha256_utf16(c: Column) -> Column:
    """SHA-256 of text in UTF-16, as a database that keeps text so digests it."""
    return F.sha2(F.encode(c, "UTF-16LE"), 256)


def pseudonym(c: Column, key: bytes) -> Column:
    """HMAC-SHA-256 in lower-case hexadecimal, by its definition in built-in functions, so that no row goes to Python."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)


def fingerprint(*parts: object) -> str:
    """SHA-256 of settings, each part on a line."""
    return hashlib.sha256("".join(f"{p}\n" for p in parts).encode()).hexdigest()


def _number(text: str) -> str:
    """A number as plain digits without needless zeros, so that 600, 600.0 and 6e2 are the same."""
    d = decimal.Decimal(text)
    if len(d.as_tuple().digits) > 28 or abs(d.adjusted()) > 28:
        return repr(float(text))
    plain = format(d.normalize(), "f")
    return "0" if plain in ("-0", "0") else plain


class _Number(str):
    pass


def canonical_json(text: str, root: list[str] = (), anywhere: list[str] = (), sets: list[str] = ()) -> str:
    """Properties in order of their names, without nulls and those left out; text recomposed; lists named in `sets` in order of their members' bytes."""

    def show(v: object, at_root: bool, name: str | None) -> str:
        if isinstance(v, _Number):
            return _number(v)
        if isinstance(v, str):
            return json.dumps(unicodedata.normalize("NFC", v), ensure_ascii=False)
        if isinstance(v, dict):
            names = ((unicodedata.normalize("NFC", k), k) for k, x in v.items() if x is not None and k not in anywhere and not (at_root and k in root))
            kept = sorted(names, key=lambda p: p[0].encode("utf-16-be"))
            return "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{show(v[k], False, k)}" for n, k in kept) + "}"
        if isinstance(v, list):
            each = [show(x, False, None) for x in v]
            return "[" + ",".join(sorted(each, key=str.encode) if name in sets else each) + "]"
        return json.dumps(v)

    return show(json.loads(text, parse_int=_Number, parse_float=_Number), True, None)


def canonical_json_hash(root: list[str] = (), anywhere: list[str] = (), sets: list[str] = ()):
    """A function of a JSON column: the SHA-256 of its canonical form, by batches; null and what is no JSON give null."""

    @F.pandas_udf(StringType())
    def hashed(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else hashlib.sha256(canonical_json(x, root, anywhere, sets).encode()).hexdigest()
            except ValueError:
                return None

        return s.map(one, na_action="ignore")

    return hashed
