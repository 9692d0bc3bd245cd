"""Scalar functions and operators on small fixtures."""

import datetime
import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, hashing, identifiers, names
from tessera.operators import blocking, calibration, identity, linkage, rules, versioning


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("  João  da   Silva ", "JOAO DA SILVA"), ("", None), ("   ", None), (None, None), ("Ñandú", "NANDU"), ("\tJOÃO\n", "JOAO"), ("\t", None), ("Strauß", "STRAUß"), ("Nguyễn", "NGUYEN"), ("a\u00a0\u2003b", "A B"), ("Ærø", "ÆRØ"), ("ѝ Й", "И И"), ("ﬁn ŉ", "ﬁN ŉ"), ("e\u0301a", "EA"), ("ı", "ı")])
def test_normalize(spark, text, want):
    assert one(spark, text, names.normalize_text) == want
    assert one(spark, text, names.normalize_text_exact) == want


@pytest.mark.parametrize("name,want", [
    ("João Silva", "JOAO SILVA"), ("Marya", "MARIA"), ("Helena", "ELENA"), ("Elena", "ELENA"), ("Philippe", "FILIPE"), ("Chavier", "XAVIER"), ("Luiz", "LUIS"), ("Joaquim", "JOAKIM"), ("Joaquin", "JOAKIM"), ("CALHEIROS", "KA1EIROS"),
    ("FILHA MANHA CHICO SCHMIDT SCENA ESCOVA QUILO", "FI1A MA3A XIKO SXMIDT SENA ESKOVA KILO"), ("Gonçalves", "GONKALVES"), ("THAIS", "THAIS"), ("JOAN SILVA", "JOAM SILVA"), ("YCY", "IKI"), ("QUADROS", "KADROS"), (None, None), ("", None), ("   ", None), ("123", None),
])
def test_phonetic(spark, name, want):
    assert one(spark, name, names.phonetic) == want


@pytest.mark.parametrize("name,want", [
    ("Dr. João da Silva Filho", ("JOAO DA SILVA FILHO", "FILHO", "SILVA", "DR", False, "JOAO")), ("João Filho", ("JOAO FILHO", None, "FILHO", None, False, "JOAO")), ("Ana", ("ANA", None, None, None, False, "ANA")), ("Maria de la Cruz jr.", ("MARIA DE LA CRUZ JR.", "JUNIOR", "CRUZ", None, False, "MARIA")),
    ("José DOS DOS Anjos", ("JOSE DOS DOS ANJOS", None, "ANJOS", None, True, "JOSE")), ("Dr Ana", ("DR ANA", None, "ANA", None, False, "DR")), ("  ", None), (None, None), ("Ana Netologia Souza", ("ANA NETOLOGIA SOUZA", None, "SOUZA", None, False, "ANA")),
])
def test_name_parts(spark, name, want):
    got = names.with_name_parts(spark.createDataFrame([(name,)], "x string"), "x", "p").first().p
    if want is None or want[3] != "DR":
        assert (got and tuple(got)) == want
    else:
        assert tuple(got)[1:] == want[1:] and got.full == "DR. " + want[0]


@pytest.mark.parametrize("a,b,want", [
    (None, "ANA", "Missing"), ("Ana Souza", "ANA SOUZA", "ExactFull"), ("Ana Maria Souza", "Ana Lima Souza", "ExactFirstLast"), ("Ana Souza", "Souza Ana", "ReversedFirstLast"), ("Mariana Oliveira Santos", "Mariana Oliveira Santoz", "HighFull"),
    ("Marta XXXXXXXXXXXX Oliveira", "Marte YY Oliveirb", "HighFirstLast"), ("Ana Souza", "Bruno Souza", "ExactLast"), ("Ana Souza", "Ana Ximenes", "ExactFirst"), ("Ana Souza", "Bruno Lima", "Other"), ("Ana", "Ana Souza", "ExactFirst"),
])
def test_nominal_levels(spark, a, b, want):
    assert names.with_nominal_level(spark.createDataFrame([(a, b)], "l string, r string"), "l", "r").first().level == want


@pytest.mark.parametrize("a,b,want", [("MARIA S SOUZA", "MARIA SILVA SOUZA", True), ("M. SOUZA", "MARIA DE SOUZA", True), ("MARIA SOUZA", "MARIA SOUZA", False), ("M SOUZA", "M SOUZA", False), ("M SOUZA", "N SOUZA", False), ("MARIA SOUZA", "MARIA LIMA", False), ("M SOUZA", "MARIA", False), (None, "M", False)])
def test_abbreviations(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(names.abbreviation_compatible(F.col("a"), F.col("b")).alias("y")).first().y
    assert got is want


def test_guarded_similarity(spark):
    """One token that differs is not made up for by a long name that is otherwise the same."""
    d = spark.createDataFrame([("MARIA APARECIDA DA SILVA", "MARIA APARECIDA DA SOUZA"), ("ANA", "ANA"), ("ANA LIMA", "ANA"), (None, "A")], "a string, b string")
    got = [r.s for r in d.select(names.guarded_similarity("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(names.jaro_winkler_of("SILVA", "SOUZA")) and got[0] < names.jaro_winkler_of("MARIA APARECIDA DA SILVA", "MARIA APARECIDA DA SOUZA")
    assert got[1] == 1.0 and got[2] == pytest.approx(names.jaro_winkler_of("ANA LIMA", "ANA")) and got[3] is None


def jaro_winkler_by_definition(a, b):
    """From the sets of matched places, with half the number of matched characters out of order as transpositions."""
    if a == b:
        return 1.0
    reach, used, left = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i in range(len(a)):
        free = [j for j in range(len(b)) if abs(i - j) <= reach and j not in used and a[i] == b[j]]
        if free:
            used.add(free[0])
            left.append(a[i])
    if not left:
        return 0.0
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != b[j] for x, j in zip(left, sorted(used))) / 2) / m) / 3
    prefix = len(os.path.commonprefix([a[:4], b[:4]]))
    return jaro + 0.1 * prefix * (1 - jaro)


def test_jaro_winkler_of_many(spark):
    rng = random.Random(6)
    pairs = [("".join(rng.choice("ABCDE") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("ABCDE") for _ in range(rng.randrange(1, 12)))) for _ in range(500)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.jaro_winkler("a", "b").alias("s")).collect()
    assert all(r.s == pytest.approx(jaro_winkler_by_definition(r.a, r.b), abs=1e-12) for r in got)


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.96111111), ("DIXON", "DICKSONX", 0.81333333), ("A", "B", 0.0), ("", "A", 0.0), ("AB", "AB", 1.0)])
def test_jaro_winkler(a, b, want):
    assert names.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-8)


def test_check_digits(spark):
    assert one(spark, "529.982.247-25", identifiers.valid_cpf) is True
    assert one(spark, "529.982.247-26", identifiers.valid_cpf) is False
    assert one(spark, "111.111.111-11", identifiers.valid_cpf) is False
    assert one(spark, None, identifiers.valid_cpf) is False


def test_cns(spark):
    valid = ["211111111110007", "111111111110000", "111111111130001", "700000000000005", "800000000000001", "900000000000008"]
    wrong = ["211111111110008", "111111111130008", "700000000000004", "800000000000002", "900000000000009", "000000000000000", "300000000000007", "70000000000000", "7000000000000050", "700 0000 0000 0005", "70000000000000A", "", None, "150300891319344", "147118013204075", "142035574485291"]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in valid + wrong], "x string").select("x", identifiers.valid_cns(F.col("x")).alias("y")).collect()}
    assert {x for x, y in got.items() if y} == set(valid) and not any(y is None for y in got.values())


def test_contacts(spark):
    assert one(spark, "+00 11 98765 4321", identifiers.phone_br) == "11987654321"
    assert one(spark, " (11) 98765-4321\t", identifiers.phone_br) == "5511987654321"
    assert one(spark, "+1 202 555 0100", identifiers.phone_br) == "12025550100"
    assert one(spark, "123", identifiers.phone_br) is None
    assert one(spark, " Ana@Example.ORG ", identifiers.email_canonical) == "ana@example.org"
    assert one(spark, "a@b@c", identifiers.email_canonical) is None


@pytest.mark.parametrize("a,b,want", [
    ("2000-01-02", "2000-01-02", "EXACT"), ("2000-01-02", "2000-02-01", "DAY_MONTH_SWAP"), ("1900-01-02", "2000-01-02", "CENTURY_SHIFT"), ("2000-01-02", "2000-01-03", "ONE_DIGIT_ERROR"),
    ("2000-01-02", "2000-01-31", "PARTIAL_2"), ("2000-01-02", "1987-12-31", "OTHER"), (None, "2000-01-02", None),
])
def test_birth_evidence(spark, a, b, want):
    d = lambda x: x and datetime.date.fromisoformat(x)
    assert spark.createDataFrame([(d(a), d(b))], "a date, b date").select(dates.birth_evidence(F.col("a"), F.col("b")).alias("e")).first().e == want


def test_linkage_decides(spark):
    scored = spark.createDataFrame([(1, 10, 5.0), (1, 11, 4.9), (2, 10, 7.0), (2, 12, 1.0), (3, 10, -9.0)], "left_id long, right_id long, odds double")
    universe = spark.createDataFrame([(1,), (2,), (3,), (4,)], "left_id long")
    got = {r.left_id: (r.status, r.reason) for r in linkage.decisions(linkage.ranked(scored), universe, 0.0, 0.5).collect()}
    assert got == {1: ("CONFLICT", "MARGIN"), 2: ("RESOLVED", None), 3: ("UNRESOLVED", "BELOW_THRESHOLD"), 4: ("UNRESOLVED", "NO_CANDIDATE")}


def test_components_and_triads(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    assert {r.id: r.component for r in linkage.smallest_labels(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert [tuple(r) for r in linkage.open_triads(edges).collect()] == [(1, 2, 3)]


def test_versions(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (2, 1, "x")], "k long, t long, v string")
    got = versioning.intervals(versioning.new_versions(e, ["k"], [F.col("t")], ["v"]), ["k"], "t").orderBy("k", "t").collect()
    assert [(r.k, r.t, r.version, r.valid_to, r.status) for r in got] == [(1, 1, 1, 3, "HISTORIC"), (1, 3, 2, 4, "HISTORIC"), (1, 4, 3, None, "CURRENT"), (2, 1, 1, None, "CURRENT")]


def test_golden(spark):
    e = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 3, "a"), (2, 1, "c"), (3, 1, None)], "k long, t long, v string")
    got = {r.k: (r.v, r.v_state) for r in versioning.golden(e, ["k"], ["v"], [F.desc("t")]).collect()}
    assert got == {1: ("a", "DIVERGENT"), 2: ("c", "BASELINE"), 3: (None, "ABSENT")}


def test_rules(spark):
    c = rules.Condition
    rule = rules.Rule("BENEFICIO", "AB12", 1, "v1", (c("n", "NUMERO_MAIOR_IGUAL", "1,000.5"), c("d", "DATA_MENOR_IGUAL", "2024-02-29")), (c("s", "IGUAL", "x"), c("u", "EM", any_of=("a", "b"))), datetime.timedelta(days=1))
    rows = [(1, "2000", "2024-01-31", "x", None), (2, " \t", "2024-01-31", "x", None), (3, "1000.4", None, "x", None), (4, "1,000.5", "2024-03-01", "x", "a"), (5, "9e9", "2024-01-01", "x", "a"), (6, "+5000", "2024-01-01", "y", "b"), (7, "5000", "2024-01-01", "y", None), (8, "5000", "2024-01-01", "X", "c"), (9, "5000", "2024-02-30", "x", "c")]
    d = spark.createDataFrame(rows, "id long, n string, d string, s string, u string")
    got = {r.id: (r.r.result, r.r.reason) for r in d.select("id", rules.evaluate(rule, F.lit(datetime.datetime(2024, 1, 1)), "missing").alias("r")).collect()}
    yes, no, unsure = ("COMPATIVEL", "REGRA_VERSIONADA_ATENDIDA"), "NAO_COMPATIVEL", "NAO_AVALIAVEL"
    assert got == {1: yes, 2: (unsure, "DADO_AUSENTE:n"), 3: (no, "REGRA_NAO_ATENDIDA:n:NUMERO_MAIOR_IGUAL"), 4: (no, "REGRA_NAO_ATENDIDA:d:DATA_MENOR_IGUAL"), 5: (unsure, "DADO_AUSENTE:n"), 6: yes, 7: (unsure, "DADOS_INSUFICIENTES_ANYOF"), 8: (no, "NENHUMA_CONDICAO_ANYOF_ATENDIDA"), 9: (unsure, "DADO_AUSENTE:d")}
    with pytest.raises(Exception, match="can't read"):
        d.where("id = 5").select(rules.evaluate(rule).alias("r")).collect()
    for wrong in (rules.Rule("X", "AB12", 1, "v", (c("a", "PRESENTE"),)), rules.Rule("SERVICO", "ab12", 1, "v", (c("a", "PRESENTE"),)), rules.Rule("SERVICO", "AB12", 1, "v"), rules.Rule("SERVICO", "AB12", 1, "v", (c("a", "IGUAL"),)), rules.Rule("SERVICO", "AB12", 1, "v", (c("a", "PRESENTE"), c("a", "PRESENTE"))), rules.Rule("SERVICO", "AB12", 1, "v", (c("a", "EM"),))):
        with pytest.raises(ValueError):
            rules.evaluate(wrong)


def test_content_hashes_tell_separators_and_nulls(spark):
    d = spark.createDataFrame([(1, 1, "a|b", "c"), (1, 2, "a", "b|c"), (1, 3, None, "~"), (1, 4, "~", None), (1, 5, "~", None)], "k long, t long, v string, w string")
    assert [r.t for r in versioning.new_versions(d, ["k"], [F.col("t")], ["v", "w"]).orderBy("t").collect()] == [1, 2, 3, 4]


def test_term_frequencies(spark):
    d = spark.createDataFrame([(0.1, 0.2), (0.001, 0.002), (None, 0.1)], "l double, r double")
    at = lambda *a: [r.y for r in d.select(linkage.term_frequency(F.col("l"), F.col("r"), *a).alias("y")).collect()]
    assert at(0.05) == pytest.approx([math.log(0.05 / 0.2), math.log(0.05 / 0.002), 0.0])
    assert at(0.05, 0.5, 0.01) == pytest.approx([0.5 * math.log(0.05 / 0.2), 0.5 * math.log(0.05 / 0.01), 0.0])
    assert at(0.05, 1.0, 0.0, "asymmetric") == pytest.approx([math.log(0.05 / 0.2), 0.0, 0.0]) and at(0.05, 0.0) == [0.0] * 3 == at(0.05, 1.0, 0.0, "zero")
    with pytest.raises(ValueError):
        linkage.term_frequency(F.col("l"), F.col("r"), 0.0)


def test_joint_cells(spark):
    cells = spark.createDataFrame([(p, m, 0.5, 0.25) for p in names.NOMINAL_LEVELS for m in names.NOMINAL_LEVELS if (p, m) != ("Other", "Other")], "person_level string, mother_level string, m double, u double")
    d = spark.createDataFrame([("ExactFull", "Missing"), ("Other", "Other")], "person_level string, mother_level string")
    assert linkage.joint_odds(d.limit(1), cells).first().joint_llr == pytest.approx(math.log(2))
    with pytest.raises(Exception, match="no cell"):
        linkage.joint_odds(d, cells).collect()


def test_guards(spark):
    scored = spark.createDataFrame([(1, 10, 0.9, 5.0, False), (1, 11, 0.4, 1.0, False), (2, 10, 0.9, 5.0, True), (3, 10, 0.9, 5.0, False), (3, 12, 0.85, 4.9, False), (4, 10, 0.3, 1.0, False), (5, 10, 0.9, 5.0, False), (5, 11, 0.7, 4.5, False), (1, 10, 0.9, 5.0, False)], "left_id long, right_id long, score double, odds double, exact_core boolean")
    universe = spark.createDataFrame([(i,) for i in range(1, 7)], "left_id long")
    said = lambda **k: {r.left_id: (r.status[:3], r.reason and r.reason[:8]) for r in linkage.resolved(scored, universe, 0.5, 1.0, **k).collect()}
    assert said() == {1: ("RES", None), 2: ("RES", None), 3: ("CON", "MARGEM_E"), 4: ("NAO", "ABAIXO_T"), 5: ("CON", "MARGEM_E"), 6: ("NAO", "SEM_CAND")}
    assert said(unique_core=True, dual=True) == said() | {2: ("CON", "NUCLEO_D"), 3: ("CON", "DOIS_CAN"), 5: ("CON", "DOIS_CAN")}
    assert said(dual=True, conflict_floor=0.35)[1] == ("CON", "SEGUNDO_")
    with pytest.raises(Exception, match="different rows"):
        linkage.resolved(scored.union(spark.createDataFrame([(1, 10, 0.8, 5.0, False)], scored.schema)), universe, 0.5, 1.0).collect()


def test_common_keys_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PART", 7)
    left = spark.range(60).selectExpr("id", "'p' pass", "if(id < 50, 'hot', string(id)) key")
    right = spark.range(100, 130).selectExpr("id", "'p' pass", "if(id < 120, 'hot', string(id - 70)) key")
    got = {(r.left_id, r.right_id) for r in blocking.candidates(left, right).collect()}
    assert got == {(a, b) for a in range(50) for b in range(100, 120)} | {(a, a + 70) for a in range(50, 60)}


def test_keys_with_history(spark):
    seen = spark.createDataFrame([(1, "name_full", "ANA", 1), (1, "name_full", "ANA", 5), (1, "name_full", "ANNA", 3), (1, "birth_day", "01", 1), (1, "birth_day", "02", 2)], "person long, feature string, value string, at long")
    now = spark.createDataFrame([(1, "name_full", "ANNA"), (1, "birth_day", "02"), (2, "birth_day", "09")], "person long, feature string, value string")
    got = {(r.person, r.feature, r.value, r.valid_from, r.valid_to, r.is_current) for r in blocking.keys_with_history(seen, now, ["birth_day"]).collect()}
    assert got == {(1, "name_full", "ANA", 1, 5, False), (1, "name_full", "ANNA", 3, 3, True), (1, "birth_day", "02", 2, 2, True), (2, "birth_day", "09", None, None, True)}


def test_statistics():
    assert calibration.non_increasing([4, 1, 3], [1, 1, 1]) == [4, 2, 2]
    assert calibration.binomial_upper(0, 10, 0.05) == pytest.approx(1 - 0.05 ** 0.1, abs=1e-9)
    assert calibration.binomial_upper(10, 10, 0.05) == 1.0


def test_canonical_json(spark):
    same = ['{"b": 600, "a": "e\u0301", "n": null}', '{"a":"\u00e9","b":6e2}', '{"a":"\u00e9", "b":600.00}']
    other = ['{"a":"\u00e9","b":601}', '{"a":"\u00e9","b":"600"}', '{"a":"\u00e9"}', "[600]", None, "{"]
    got = {r.x: r.h for r in spark.createDataFrame([(x,) for x in same + other], "x string").select("x", hashing.canonical_json_hash()("x").alias("h")).collect()}
    assert len({got[x] for x in same}) == 1 and len({got[x] for x in other[:4]} | {got[same[0]]}) == 5 and got[None] is None and got["{"] is None
    assert got[same[0]] == hashlib.sha256('{"a":"\u00e9","b":600}'.encode()).hexdigest()
    show = hashing.canonical_json
    person = {"root": hashing.PERSON_ROOT, "anywhere": hashing.PERSON_ANYWHERE, "sets": hashing.PERSON_SETS}
    assert show('{"codigoPessoaOrigem":1,"x":{"codigoPessoaOrigem":1,"atualizadoEmOrigem":2},"valores":["b","a"],"l":["b","a"]}', **person) == '{"l":["b","a"],"valores":["a","b"],"x":{"codigoPessoaOrigem":1}}'
    assert show("[-0.0, 0.10, 1E+3, 123456789012345678, true, null]") == "[0,0.1,1000,123456789012345678,true,null]"


def test_pseudonyms(spark):
    import hmac

    for key in (b"k", b"x" * 100):
        got = one(spark, "52998224725", lambda c, key=key: hashing.pseudonym(c, key))
        assert got == hmac.new(key, b"52998224725", "sha256").hexdigest()
    assert one(spark, None, lambda c: hashing.pseudonym(c, b"k")) is None
    assert one(spark, "Zé", hashing.sha256_utf16) == hashlib.sha256("Zé".encode("utf-16-le")).hexdigest()


def test_successors(spark):
    rows = [(i, i + 1) for i in range(31)] + [(31, None)] + [(100 + i, 101 + i) for i in range(32)] + [(132, None), (200, 201), (201, 200), (300, 999), (301, None)]
    got = {r.id: r.canonical for r in identity.canonical_ids(spark.createDataFrame(rows, "id long, successor long")).collect()}
    assert got[0] == 31 and got[31] == 31 and got[100] is None and got[101] == 132 and got[200] is None and got[300] == 999 and got[301] == 301


def test_rising_ratios_are_found(spark):
    d = spark.createDataFrame([("n", 1, 0.9, 0.1), ("n", 2, 0.2, 0.1), ("n", 3, 0.1, 0.2), ("o", 1, 0.1, 0.2)], "f string, place int, m double, u double")
    assert calibration.checked_ratios(d, ["f"]).count() == 4
    with pytest.raises(Exception, match="rises at place 3"):
        calibration.checked_ratios(d.union(spark.createDataFrame([("p", 1, 0.1, 0.2), ("p", 3, 0.2, 0.2)], d.schema)), ["f"]).collect()
