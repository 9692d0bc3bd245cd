"""Packages and streams."""

import datetime

from tessera.sources import packages
from tessera.streaming import throughput


def test_packages(spark, tmp_path):
    members = {"manifest.json": "{}", "pessoas.jsonl": '{"a":1}\n{"a":2}\n', "registros.jsonl": ""}
    packages.write_package(str(tmp_path / "a.zip"), members)
    packages.write_package(str(tmp_path / "b.zip"), members)
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = packages.read_packages(spark, str(tmp_path))
    assert got.where("member = 'pessoas.jsonl'").count() == 4 and got.where("problem = 'NO_ZIP'").count() == 1
    assert packages.orphans(got.select("sha256").distinct(), got.where("problem is null")).count() == 1


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10, 5)
    rows = [(1, t, "a"), (1, t, "a"), (2, t + datetime.timedelta(minutes=10), "a"), (3, t + datetime.timedelta(hours=1), "b")]
    spark.createDataFrame(rows, "id long, ts timestamp, kind string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    out = throughput.first_deliveries(stream, ["id"]).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted(r.id for r in spark.table("firsts").collect()) == [1, 2, 3]
    out = throughput.hourly(stream, ["kind"]).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert sorted((r.hour.hour, r.kind, r.n) for r in spark.table("hours").collect()) == [(10, "a", 3), (11, "b", 1)]
