"""Operators that SQL doesn't answer: groups, rules, contracts, snapshots, streams and every measure by name."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import grouping, identity, linkage, measures, samplers, thresholds
from tessera.sources import contracts, snapshots
from tessera.streaming import versions


def test_every_measure_has_a_value(spark):
    texts = {"estado", "status", "natureza", "resultado", "metodo_resolucao", "linkage_status", "motivo", "situacao_geografia", "cpf_classificacao", "qc_implementacao", "status_atraso", "estado_atribuicao_identidade", "beneficio", "gestor", "codigo", "canonical_uuid", "servico", "escopo", "nome_servico"}
    words = re.compile(r"\b[a-z][a-z_0-9]*_[a-z_0-9]+\b|\b(?:erro|estado|status|natureza|resultado|motivo|score|pessoas|beneficio|gestor|codigo|servico|retransmitido|processada|avaliados|resolvidos|conflitos|conflito|retransmitidos)\b")
    for table, found in measures.MEASURES.items():
        columns = {w for e in found.values() for w in words.findall(re.sub(r"'[^']*'", "", e))} - {"count_if", "try_divide", "current_timestamp"}
        typed = [("current_timestamp()" if c == "ocorrido_em" else "true" if c.startswith("apta") else f"'{c}'" if c in texts else "1") + f" as {c}" for c in columns or ["x"]]
        rows = spark.sql("select " + ", ".join(t if " as " in t else "1 as x" for t in typed))
        assert measures.measured(rows, table).columns == list(found)
        assert measures.measured(rows, table).count() == 1
        if columns:
            assert measures.measured(rows.where("false"), table).first()[0] is None


def test_measures_treat_blanks_as_the_model_does(spark):
    d = spark.createDataFrame([("A", 10.0, "x"), (None, 5.0, None), ("ATRIBUIDA", 1.0, "x")], "estado_atribuicao_identidade string, valor_concedido double, gestor string")
    d = d.withColumn("beneficio", F.lit(None).cast("string"))
    got = measures.measured(d, "BeneficiosConcedidos").first()
    assert got["Benefícios pendentes/conflitantes"] == 2 and got["Valor pendente/conflitante"] == 15 and got["Gestores"] == 2 and got["Tipos de Benefício"] == 1
    people = spark.createDataFrame([("TOTAL", None, 7), ("GESTOR", "a", 5), ("GESTOR", "b", 4)], "escopo string, gestor string, pessoas int")
    assert measures.measured(people, "BeneficiosPessoas").first()[0] == 7
    assert {r[0]: r[1] for r in measures.measured(people, "BeneficiosPessoas", by=("gestor",)).collect()} == {None: None, "a": 5, "b": 4}


def test_complete_link(spark):
    rnd = random.Random(5)
    people = [(i, "N", "2000-01-01" if i != 9 else None, f"m{i}") for i in range(24)]
    edges = [(a, b, round(rnd.uniform(1, 9), 3), round(rnd.uniform(1, 9), 3)) for a, b in itertools.combinations(range(24), 2) if rnd.random() < 0.75 and a // 12 == b // 12]
    obs = spark.createDataFrame(people, "id long, name string, birth string, manager string")
    got = {r.id: r.group_id for r in grouping.complete_link(obs, spark.createDataFrame(edges, "a long, b long, ab double, ba double"), 2.0, ["name", "birth"], "manager", cap=5).collect()}
    strong = {(a, b): min(x, y) for a, b, x, y in edges if min(x, y) >= 2.0 and 9 not in (a, b)}
    groups = [{i} for i in range(24)]
    for (a, b), _ in sorted(strong.items(), key=lambda e: (-e[1], e[0])):
        x, y = (next(g for g in groups if i in g) for i in (a, b))
        if x is not y and len(x | y) <= 5 and all((min(p, q), max(p, q)) in strong for p in x for q in y):
            groups = [g for g in groups if g is not x and g is not y] + [x | y]
    assert got == {i: min(g) for g in groups for i in g}
    assert len(set(got.values())) < 24 and got[9] == 9
    with pytest.raises(Exception, match="over 1"):
        grouping.complete_link(obs, spark.createDataFrame(edges, "a long, b long, ab double, ba double"), 2.0, ["name"], "manager", most=1).count()


def test_labels_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    got = linkage.smallest_labels(edges, spark.range(61))
    assert got.where("component = 0").count() == 61


def test_shared_documents(spark):
    d = spark.createDataFrame([("ANA SOUZA", "2000-01-01", "BRUNO LIMA", "1990-05-05"), ("ANA SOUZA", "2000-01-01", "ANA SOUSA", "1990-05-05"), ("ANA", None, "ZELIA", "1990-05-05"), (None, "2000-01-01", "ZELIA", "1990-05-05")], "n string, b string, m string, c string")
    assert [r.conflict for r in identity.shared_document_conflicts(d, ("n", "b"), ("m", "c")).collect()] == [True, False, False, False]


def test_promotion_and_universe(spark):
    d = spark.createDataFrame([(1, "p", "A", True, 3), (2, "p", "A", True, 5), (3, "p", "A", False, 9), (4, "p", "B", False, 1)], "id long, person string, attribute string, proven boolean, at int")
    assert [r.id for r in identity.promoted(d, ["person", "attribute"], F.col("proven"), [F.desc("at"), F.desc("id")]).collect()] == [2]
    o = spark.createDataFrame([(1, None, "S", "2024-01-01"), (2, "1", "S", "2024-01-01"), (3, None, "T", "2024-02-01"), (9, None, "S", "2024-03-01")], "observation_id long, cpf string, manager string, received_at string")
    assert [r.observation_id for r in identity.eligible(o, 5).collect()] == [1, 3]
    assert [r.observation_id for r in identity.eligible(o, 9, "S", "2024-02-01").collect()] == [9]


def test_front_and_calibration(spark):
    rnd = random.Random(3)
    points = [{"fp": rnd.randrange(8), "fn": rnd.randrange(8), "i": i} for i in range(60)]
    beaten = lambda p: any(q["fp"] <= p["fp"] and q["fn"] <= p["fn"] and (q["fp"], q["fn"]) != (p["fp"], p["fn"]) for q in points)
    assert sorted(p["i"] for p in thresholds.front(points)) == [p["i"] for p in points if not beaten(p)]
    assert thresholds.grid([3, 1, 2, 2, 5, 4], 3) == [1, 3, 5] and thresholds.error_budget(1001, 10) == 2
    rows = spark.createDataFrame([(1, 1, 5.0, None), (2, 3, 1.0, 2.0), (4, 4, 2.0, 3.0), (None, 6, 0.5, 1.0), (7, None, None, None)], "truth long, best long, odds double, margin double")
    got = thresholds.calibrate(rows, rows, [0.0, 1.5, 4.0], [0.0])
    assert got["chosen"] == {"threshold": 1.5, "margin": 0.0, "tp": 2, "fp": 0, "fn": 2} and got["passes"]
    with pytest.raises(ValueError, match="budget"):
        thresholds.calibrate(rows, rows, [0.0], [0.0])


def test_rule_search_against_every_pair(spark):
    rnd = random.Random(8)
    rows = [tuple(rnd.choice([True, False, None]) for _ in range(4)) + (rnd.random() < 0.4,) for _ in range(300)]
    names = ["a", "b", "c", "d"]
    found = thresholds.rule_search(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, truth boolean"), names, "truth", 2, 2)
    assert len({json.dumps(r["rule"]) for r in found}) == len(found) > 20
    for r in found:
        hit = [x for x in rows if any(all(x[names.index(f)] for f in c) for c in r["rule"])]
        assert r["kept"] == len(hit) and r["recall"] == pytest.approx(sum(x[4] for x in hit) / sum(x[4] for x in rows))
    with pytest.raises(ValueError, match="rules"):
        thresholds.rule_search(spark.createDataFrame(rows, "a boolean, b boolean, c boolean, d boolean, truth boolean"), names, "truth", 2, 2, cap=5)


def test_sufficiency(spark):
    d = spark.createDataFrame([("s", 1, 2, 1, "g"), ("s", 2, 1, 1, "g"), ("s", 3, 4, 1, "h"), ("t", 1, 2, 1, "g"), ("t", 2, 1, 0, "g")], "stratum string, a long, b long, truth int, grp string")
    got = {r.stratum: (r.pairs, r.groups, r.contradictory, r.sufficient) for r in samplers.sufficiency(d, ["stratum"], 2, 2).collect()}
    assert got == {"s": (2, 2, 0, True), "t": (1, 1, 1, False)}


def test_contracts(spark):
    schema = {
        "type": "object", "required": ["id"], "additionalProperties": False,
        "properties": {"id": {"type": "string", "minLength": 2, "pattern": "^[a-z]+$"}, "day": {"type": ["string", "null"], "format": "date"}, "kind": {"enum": ["x", 1]}, "tags": {"type": "array", "items": {"type": "integer"}}},
        "if": {"properties": {"kind": {"const": "x"}}, "required": ["kind"]}, "then": {"required": ["day"]},
    }
    cases = {
        '{"id":"ab"}': [], '{"id":"A"}': ["$.id: minLength", "$.id: pattern"], "{}": ["$.id: required"], '{"id":"ab","kind":true}': ["$.kind: enum"], '{"id":"ab","kind":"x"}': ["$.day: required"],
        '{"id":"ab","kind":"x","day":"2024-02-30"}': ["$.day: format"], '{"id":"ab","tags":[1,1.5,true]}': ["$.tags[1]: type", "$.tags[2]: type"], '{"id":"ab","more":1}': ["$.more: additionalProperties"], "[]": ["$: type"], "{": ["$: json"], '{"id":NaN}': ["$: json"],
    }
    d = spark.createDataFrame([(k, 1) for k in cases] + [(None, 1)], "line string, other int")
    got = {r.line: r.violations for r in contracts.validated(d, schema).collect()}
    assert got == cases | {None: None}
    with pytest.raises(ValueError, match="subset"):
        contracts.check_contract({"properties": {"a": {"items": {"oneOf": []}}}})


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "s")
    parts = snapshots.capture(spark.range(1000).withColumn("v", F.col("id") * 2), at, ["id"], rows_a_part=300)
    assert parts.count() >= 4 and snapshots.replay(spark, at).agg(F.sum("v")).first()[0] == 999000
    files = sorted((tmp_path / "s" / "data").glob("*.parquet"))
    files[0].write_bytes(files[1].read_bytes())
    for f in (tmp_path / "s" / "data").glob(".*.crc"):
        f.unlink()
    files[2].unlink()
    assert sorted(r.problem for r in snapshots.verify(spark, at).collect()) == ["CHANGED", "MISSING"]
    with pytest.raises(ValueError, match="not what was captured"):
        snapshots.replay(spark, at)


def test_versions_over_micro_batches(spark, tmp_path):
    ops = [[("f", 1, "INCLUSAO", "a"), ("f", 2, "INCLUSAO", "a"), ("g", 1, "ALTERACAO", "z")], [("f", 4, "EXCLUSAO", "b"), ("f", 3, "ALTERACAO", "b")], [("f", 5, "ALTERACAO", "c"), ("f", 6, "INCLUSAO", "c"), ("f", 7, "RETIFICACAO", "c"), ("f", 8, "EXCLUSAO", "c")]]
    schema = "fact string, seq long, operation string, content string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in ops:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = versions.folded(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("fact", "seq", "result", "version").collect())
    assert got == [("f", 1, "INCLUIDO", 1), ("f", 2, "RETRANSMITIDO", 1), ("f", 3, "VERSIONADO", 2), ("f", 4, "EXCLUIDO", 3), ("f", 5, "REJEITADO", 3), ("f", 6, "REABERTO", 4), ("f", 7, "REJEITADO", 4), ("f", 8, "EXCLUIDO", 5), ("g", 1, "REJEITADO", 0)]
    table = spark.createDataFrame([r for rows in ops for r in rows], schema)
    assert sorted(tuple(r) for r in versions.folded_batch(table).select("fact", "seq", "result", "version").collect()) == got
