"""Every query of the library against its SQL on the smallest tables."""

import os

import pytest

from tessera.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shown(v):
    if v is None or v != v or str(v) == "<NA>":
        return "~"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__module__ in ("numpy", "decimal") and str(v).replace(".", "").replace("-", "").isdigit() else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query(spark, duck, name):
    got = all_queries()[name](spark, SF)
    want = duck.sql(all_oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_name_similarity_by_definition(spark):
    """The one query without SQL: the other engine counts transpositions in another way."""
    from test_functions import jaro_winkler_by_definition

    assert set(all_queries()) - set(all_oracles()) == {"name_similarity"}
    rows = all_queries()["name_similarity"](spark, SF).collect()
    assert len(rows) > 100 and len({r.level for r in rows}) > 3
    for r in rows:
        s = jaro_winkler_by_definition(r.x, r.y)
        assert r.similarity == pytest.approx(s, abs=1e-8) and r["class"] == ("HIGH" if s >= 0.92 else "MEDIUM" if s >= 0.8 else "LOW") and r.guarded <= r.similarity


def test_first_lines_are_read_whole(spark):
    """Against Unicode's own rules in plain Python; some lines are longer than 200 characters."""
    import unicodedata

    def normal(line):
        bare = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", line) if unicodedata.category(c) != "Mn"))
        return " ".join("".join(c if len(c.upper()) > 1 else c.upper() for c in bare).split()) or None

    lines = {r.doc_id: (r.text or "").split("\n")[0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {d: normal(x) for d, x in lines.items()}
    assert max(len(x or "") for x in want.values()) > 200
    assert {r.doc_id: r.name for r in all_queries()["normalized_names"](spark, SF).collect()} == want
