"""WARC round trips and URL rules."""

import base64
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filter, warc
from tessera.llm.bloom import BlockedBloom
from tessera.llm.common import components, scratch_dir, skew_safe_lookup

PAGES = [(1, "http://a/", "x"), (2, "http://b/\n", "x"), (3, None, "é" * 90000), (4, "http://c/", None), (5, "http://d/", ""), (5, "http://d/", ""), (None, "http://e/", "x"), (9, "http://f/", "é" * 90000)]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(p, u, h, "clash") for p, u, h in PAGES], "page_id long, url string, html string, sha1 string")


def expected():
    first = {}
    for p, _, h in PAGES:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for p, _, h in PAGES:
        b = (h or "").encode()
        revisit = p is not None and first[h or ""] != p
        yield p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None


def test_round_trip(pages):
    got = warc.round_trip(pages).collect()
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, expected()))
    assert warc.round_trip(pages.where("false")).count() == 0


def test_pushed_predicates_and_splits(spark, pages, monkeypatch):
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    warc.archive_pages(pages, path)
    revisits = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'")
    many = sum(kind == "revisit" for _, _, _, kind, _ in expected())
    assert many == 4 and revisits.count() == many and revisits.where("payload is not null").count() == 0
    assert "record_type = " not in revisits._jdf.queryExecution().executedPlan().toString()
    assert warc.read_warc(spark, path).where("target_uri in ('http://a/', 'http://c/')").count() == 2
    reader = warc.WarcReader({"path": path})
    whole = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(warc, "SPLIT", 300)
    small = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(reader.partitions()) > 3 and sorted(map(str, whole)) == sorted(map(str, small))


def test_foreign_members(spark, tmp_path):
    import gzip

    record = lambda i: warc.record_bytes("response", f"urn:page:{i}", "http://x/", "2024-01-01T00:00:00Z", None, warc.digest_of(b"y" * i), b"y" * i)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in (0, 5, 100000)))
    (tmp_path / "b.warc").write_bytes(b"".join(record(i) for i in (1, 7, 50000)))
    got = {r.record_id: (r.payload_bytes, len(r.payload)) for r in warc.read_warc(spark, str(tmp_path), verify=True).collect()}
    assert got == {f"urn:page:{i}": (i, i) for i in (0, 5, 100000, 1, 7, 50000)}
    assert warc.read_warc(spark, str(tmp_path)).where("record_id = 'urn:page:7'").count() == 1


def archive(path, *blocks, zipped=True, headers=""):
    """An archive of response records with these blocks and no digest header."""
    import gzip

    records = [f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{i}>\r\n{headers}Content-Type: application/http\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks)]
    path.write_bytes(b"".join(map(gzip.compress, records) if zipped else records))


@pytest.mark.parametrize("zipped", [True, False])
def test_heads_and_bodies_of_other_crawlers(spark, tmp_path, zipped):
    """Long heads, LF alone, chunked bodies, no digest, payloads that are archives."""
    cookie = b"HTTP/1.1 200 OK\r\nSet-Cookie: " + b"c" * 40_000 + b"\r\n\r\n"
    inner = b"x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    bodies = [b"thirteen byte", b"", b"body", b"Wikipedia", inner]
    heads = [cookie, cookie * 1, b"HTTP/1.0 200 OK\nA: b\n\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"]
    sent = [*bodies[:3], b"4;x=y\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n", inner]
    archive(tmp_path / ("a.warc.gz" if zipped else "a.warc"), *(h + b for h, b in zip(heads, sent, strict=True)), zipped=zipped)
    got = {r.record_id: (r.payload_bytes, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path), verify=True).collect()}
    assert got == {f"urn:{i}": (len(b), b) for i, b in enumerate(bodies)}
    light = {r.record_id: (r.payload_bytes, r.payload) for r in warc.read_warc(spark, str(tmp_path), payload=False).collect()}
    assert light == {f"urn:{i}": (None if i == 3 else len(b), None) for i, b in enumerate(bodies)}


def test_a_head_without_end(spark, tmp_path):
    archive(tmp_path / "a.warc.gz", b"HTTP/1.1 200 OK\r\nA: " + b"x" * 50_000, b"HTTP/1.1 200 OK\r\n\r\nfine")
    with pytest.raises(Exception, match="never ends"):
        warc.read_warc(spark, str(tmp_path)).collect()
    warc.register(spark)
    got = spark.read.format("warc").option("malformed", "null").load(str(tmp_path)).orderBy("record_id").collect()
    assert [(r.payload_bytes, r.payload) for r in got] == [(None, None), (4, b"fine")]


def test_wrong_digests_are_found(spark, tmp_path):
    archive(tmp_path / "a.warc.gz", b"HTTP/1.1 200 OK\r\n\r\nfine", headers=f"WARC-Payload-Digest: sha1:{warc.digest_of(b'other')}\r\n")
    assert warc.read_warc(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="another digest"):
        warc.read_warc(spark, str(tmp_path), verify=True).collect()


def test_plain_archives_split_when_told_so(tmp_path, monkeypatch):
    archive(tmp_path / "a.warc", *(b"HTTP/1.1 200 OK\r\n\r\n" + b"y" * i for i in range(200)), zipped=False)
    reader = lambda split: warc.WarcReader({"path": str(tmp_path), "split_plain": split})
    rows = lambda r: sorted((x["record_id"], x["payload_bytes"]) for p in r.partitions() for b in r.read(p) for x in b.to_pylist())
    whole = rows(reader("false"))
    for step in (97, 300, 1000):
        monkeypatch.setattr(warc, "SPLIT", step)
        assert len(reader("true").partitions()) > 20 > len(reader("false").partitions()) and rows(reader("true")) == rows(reader("false")) == whole
    assert len(whole) == 200


def test_member_lengths(monkeypatch):
    import gzip

    record = warc.record_bytes("revisit", "a", None, "d", "b", "X", b"", 17)
    assert gzip.decompress(warc.member(record)) == record and b"Content-Length: 17\r\n\r\n" in record


def test_base32(spark):
    got = spark.createDataFrame([(str(i),) for i in range(50)], "x string").select("x", warc.base32_of_hex(F.sha1("x")).alias("b"), warc.base32_of_hex(F.lit(None).cast("string")).alias("n")).collect()
    assert all(r.b == warc.digest_of(r.x.encode()) and r.n is None for r in got)


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://A.example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://example.net/de/", "example.net", "/de/", "net/", "block"), ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("https://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://net", "net", "", None, "allow"), (None, "", "", None, "allow"), ("nothing", "", "", None, "allow"),
    ("http://listed.com/a/?b=2&a=1", "listed.com", "/a/", None, "block"), ("https://www.LISTED.com:443/a?a=1&utm_source=z&b=2#x", "www.listed.com:443", "/a", None, "block"), ("http://listed.com/a", "listed.com", "/a", None, "allow"),
])
def test_urls(spark, url, host, path, rule, verdict):
    listed = spark.createDataFrame([("listed.com/a?a=1&b=2", 1), ("other.com", 1), ("", 1)], "canonical string, copies long")
    r = url_filter.judge_urls(spark.createDataFrame([(1, url, "mine")], "page_id long, url string, host string"), listed).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_empty_lists(spark):
    none = spark.createDataFrame([], "canonical string, copies long")
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(pages, none).collect()] == ["allow", "allow"]
    assert url_filter.judge_urls(pages.where("false"), none).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000)
    bloom = BlockedBloom.build(keys, F.xxhash64("id"))
    tested = bloom.tested(spark.range(20000), F.xxhash64("id"))
    assert tested.where("id < 5000 and not possible").count() == 0
    assert tested.where("id >= 5000 and possible").count() < 600


def test_hot_rows_are_dealt_by_their_salt(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 k", "id").write.parquet(str(tmp_path / "rows"))
    spark.range(7).selectExpr("id k", "id v", "id w").write.parquet(str(tmp_path / "table"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew_safe_lookup(spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "table")), ["k"], ["v"], "w", F.col("id"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert all("_salt" in line for line in plan.split("\n") if "hashpartitioning" in line) and "hashpartitioning" in plan


def test_lookup_and_components(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).cast("long").alias("k"), "id")
    table = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") == 1, 700).otherwise(1).alias("w"))
    got = skew_safe_lookup(rows, table, ["k"], ["v"], "w", F.col("id"))
    assert got.count() == 1000 and got.where("v = 2").count() == 700 and got.where("v is null").count() == 100
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    assert {r.component for r in components(chain).collect()} == {0, 100}
