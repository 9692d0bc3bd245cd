"""WARC archives: a PySpark Python data source ("warc") that writes and reads them.

Reading plans file partitions (byte ranges of large files; a range begins at its first gzip member that starts a record),
takes equality and IN predicates on record_type, record_id, target_uri, refers_to and payload_digest,
and parses a record's headers first: when the headers fail a predicate, or the payload is not asked for, the rest of the
record is neither inflated nor decoded. Each record is a gzip member of its own, and members written here carry their
compressed length in the "sl" extra field, so that such a reader jumps to the next; members without it are inflated through.

Writing makes one file a task and a manifest at commit; where there is a manifest, readers take only the files in it, so what
a lost or repeated task has left behind is never read.

Options: path; payload ("true"): decode payloads; verify ("false"): check each decoded payload against its digest, where the
record has a SHA-1 one; malformed ("fail"): what a record of type application/http without the end of an HTTP head does: "fail"
raises, "null" leaves its payload and its length null; split_plain ("false"): read uncompressed archives in ranges too.
Uncompressed archives hold nothing that tells a record from a payload that is an archive itself, so they are read by a task each unless
split_plain says that payloads are none. HTTP heads may have any length and end lines with LF alone; chunked bodies are
joined, so payload_bytes is null for them where payloads are not asked for.
Paths may be in any store that pyarrow opens. Nulls: a null payload is written as empty, a null URI as no header.
An archive without records gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tessera.llm.bloom import BlockedBloom
from tessera.llm.common import materialize, scratch_dir, skew_safe_lookup, small_batches

#: Bytes of a file that one task reads, of a first read of a record, and of an Arrow batch.
SPLIT, PEEK, BATCH = 128 << 20, 16 << 10, 8 << 20
SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, payload_bytes long, payload binary"
HEADERS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-date": "warc_date", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest"}
MAGIC = b"\x1f\x8b\x08"
HTTP_END = re.compile(rb"\r?\n\r?\n")
#: The head of a record in an uncompressed archive, behind the end of the one before.
PLAIN_HEAD = re.compile(rb"\r\n\r\n(?=WARC/\d\.\d\r\n)")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member of the record, with its compressed length in the extra field where 32 bits hold it."""
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    fits = max(size, len(record)) < 1 << 32
    extra = struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(record)) if fits else b""
    return MAGIC + (b"\x04" if fits else b"\x00") + bytes(6) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def unchunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as its chunks are whole; a body that isn't chunked after all stays as it is."""
    out, at = [], 0
    while m := re.compile(rb"\s*([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(body, at):
        n = int(m[1], 16)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
        if not n:
            break
    return b"".join(out) if at else body


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, refers_to: str | None, digest: str, payload: bytes, size: int | None = None) -> bytes:
    """A response with an HTTP head and the payload; a revisit keeps the HTTP head alone, whose Content-Length tells the payload's: size, or that of payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Inflating:
    """One gzip member (or plain bytes) from an offset on, inflated as far as it is asked for."""

    def __init__(self, f: pa.NativeFile, at: int, size: int):
        self.f, self.at, self.size = f, at, size
        f.seek(at)
        self.raw = f.read(min(PEEK, size - at))
        self.zipped = self.raw[:3] == MAGIC
        self.taken = len(self.raw)
        self.length = None
        if self.zipped:
            if len(self.raw) > 24 and self.raw[3] & 4 and self.raw[12:14] == b"sl":
                self.length = struct.unpack("<I", self.raw[16:20])[0]
            self.z = zlib.decompressobj(31)
            self.out = self.z.decompress(self.raw, PEEK)
        else:
            self.out = self.raw

    def ended(self) -> bool:
        return self.z.eof if self.zipped else self.at + self.taken >= self.size

    def more(self, want: int) -> None:
        """Until want bytes are there, or the member ends."""
        parts, have = [self.out], len(self.out)
        while have < want and not self.ended():
            if self.zipped:
                data = self.z.unconsumed_tail
                if not data:
                    data = self.f.read(1 << 20)
                    self.taken += len(data)
                    if not data:
                        break
                got = self.z.decompress(data, max(PEEK, want - have))
            else:
                got = self.f.read(min(1 << 20, self.size - self.at - self.taken))
                self.taken += len(got)
                if not got:
                    break
            parts.append(got)
            have += len(got)
        self.out = b"".join(parts)

    def next_offset(self, record_end: int) -> int:
        """Where the next record starts; record_end: length of this record."""
        if not self.zipped:
            return self.at + record_end
        if self.length:
            return self.at + self.length
        while not self.z.eof:
            self.out = b""
            data = self.z.unconsumed_tail or self.f.read(1 << 20)
            self.taken += 0 if data is self.z.unconsumed_tail else len(data)
            if not data:
                return self.size
            self.z.decompress(data, 1 << 20)
        return self.f.tell() - len(self.z.unused_data)


def f_is_gzip(f: pa.NativeFile) -> bool:
    f.seek(0)
    return f.read(3) == MAGIC


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split_plain = options.get("split_plain", "false").lower() == "true"
        self.malformed = options.get("malformed", "fail").lower()
        self.accepted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS.values():
                self.accepted.append((f.attribute[0], frozenset(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, path = opened(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            manifest = fs.get_file_info(f"{path}/manifest.json")
            if manifest.type == pafs.FileType.File:
                with fs.open_input_stream(manifest.path) as f:
                    files = fs.get_file_info([f"{path}/{x}" for x in json.loads(f.read())])
            else:
                files = [x for x in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        out = []
        for x in files:
            step = SPLIT if x.path.endswith(".gz") or self.split_plain else max(SPLIT, x.size)
            out += [Range(x.path, at, min(at + step, x.size)) for at in range(0, x.size, step)]
        return out or [Range("", 0, 0)]

    def first_record(self, f: pa.NativeFile, start: int, size: int) -> int:
        """The first gzip member, or head of a plain record, from start on that holds a record."""
        if not f_is_gzip(f):
            at = max(0, start - 4)
            while at < size:
                f.seek(at)
                if m := PLAIN_HEAD.search(f.read((1 << 20) + 64)):
                    return at + m.end()
                at += 1 << 20
            return size
        at = start
        while at < size:
            f.seek(at)
            data = f.read((1 << 20) + 64)
            i = data.find(MAGIC)
            while i >= 0:
                try:
                    if zlib.decompressobj(31).decompress(data[i : i + 4096] if i + 4096 <= len(data) else data[i:], 16).startswith(b"WARC/"):
                        return at + i
                except zlib.error:
                    pass
                i = data.find(MAGIC, i + 1)
            at += 1 << 20
        return size

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        if partition.path:
            fs, _ = opened(self.path)
            size = fs.get_file_info(partition.path).size
            with fs.open_input_file(partition.path) as f:
                at = self.first_record(f, partition.start, size) if partition.start else 0
                while at < partition.end:
                    row, at = self.record(f, partition.path, at, size)
                    if row is not None:
                        rows.append(row)
                        held += len(row[-1] or b"") + 500
                        if held > BATCH:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    def record(self, f: pa.NativeFile, path: str, at: int, size: int) -> tuple[tuple | None, int]:
        """The record at an offset, or None where it fails a predicate; the offset of the next."""
        m = Inflating(f, at, size)
        while (end := m.out.find(b"\r\n\r\n")) < 0:
            have = len(m.out)
            m.more(have + PEEK)
            if len(m.out) == have:
                raise ValueError(f"no record at {path}:{at}")
        fields = header_fields(m.out[:end])
        length = int(fields.get("content-length", 0))
        total = end + 4 + length
        got = {column: fields[h].removeprefix("<").removesuffix(">") for h, column in HEADERS.items() if h in fields}
        algorithm = ""
        if "payload_digest" in got:
            algorithm, _, got["payload_digest"] = got["payload_digest"].rpartition(":")
        if any(got.get(column) not in values for column, values in self.accepted):
            return None, m.next_offset(total + 4)
        payload, payload_bytes = None, length
        begin, whole, chunked = end + 4, True, False
        revisit = got.get("record_type") == "revisit"
        if fields.get("content-type", "").startswith("application/http"):
            while not (http_end := HTTP_END.search(m.out, begin, total)) and len(m.out) < total:
                have = len(m.out)
                m.more(min(total, 2 * have + PEEK))
                if len(m.out) == have:
                    break
            if not http_end and self.malformed != "null" and not revisit:
                raise ValueError(f"the HTTP head at {path}:{at} never ends")
            whole = bool(http_end)
            http = header_fields(m.out[begin : http_end.start() if http_end else total].replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
            begin = http_end.end() if http_end else total
            chunked = "chunked" in http.get("transfer-encoding", "").lower()
            told = http.get("content-length", "")
            payload_bytes = int(told) if revisit and told.isdigit() else None if chunked or not whole else total - begin
        if self.decode and not revisit and whole:
            m.more(total)
            body = m.out[begin:total]
            payload = unchunked(body) if chunked else body
            payload_bytes = len(payload)
            digest = got.get("payload_digest")
            # Some writers digest the body as it came and not what its chunks hold.
            if self.verify and digest and algorithm.lower() in ("sha1", "") and digest not in (digest_of(payload), digest_of(body)):
                raise ValueError(f"the payload at {path}:{at} has another digest")
        row = (path, at, *(got.get(c) for c in HEADERS.values()), length, payload_bytes, payload)
        return row, m.next_offset(total + 4)


NAMES = ["file", "offset", *HEADERS.values(), "content_length", "payload_bytes", "payload"]
TYPES = [pa.string(), pa.int64(), *[pa.string()] * len(HEADERS), pa.int64(), pa.int64(), pa.binary()]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_type, record_id, target_uri, warc_date, refers_to, payload_digest (bare base32 SHA-1), payload, and payload_bytes,
    which may be null where the payload is there. A revisit needs no payload but its digest and length."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        name, some = f"part-{uuid.uuid4().hex}.warc.gz", False
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            for b in iterator:
                for r in b.to_pylist():
                    payload = r["payload"] or b""
                    out.write(member(record_bytes(r["record_type"], r["record_id"], r["target_uri"], r["warc_date"], r["refers_to"], r["payload_digest"] or digest_of(payload), payload, r.get("payload_bytes"))))
                    some = True
        if not some:
            fs.delete_file(f"{path}/{name}")
        return Written([name] if some else [])

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        names = [n for m in messages if m for n in m.files]
        manifest = f"{path}/manifest.json"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                names = json.loads(f.read()) + names
        with fs.open_output_stream(manifest, compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        fs, path = opened(self.path)
        for m in messages:
            for n in m.files if m else []:
                fs.delete_file(f"{path}/{n}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)


def base32_of_hex(c: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: each ten of them are 40 bits and eight letters."""
    five = lambda part, i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(F.conv(part, 16, 10).cast("long"), 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1))
    return F.concat(*(five(F.substring(c, 10 * k + 1, 10), i) for k in range(4) for i in range(8)))


def archive_pages(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of pages (page_id, url, html) to path.

    Of records with equal payloads of at least `least` bytes, those with the smallest page_id are responses and the others
    revisit it. Rows with a null page_id are responses. Rows that repeat the smallest page_id are responses too.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    told = rows.drop("payload")
    copied = told.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).groupBy("sha1", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copied = materialize(copied, "copied")
    key = F.xxhash64("sha1")
    # Only digests are looked up; payloads stay where they are, but for those of pages that the filter of revisits lets through wrongly.
    met = skew_safe_lookup(BlockedBloom.build(copied, key).possible(told.where("page_id is not null"), key), copied, ["sha1", "size"], ["first"], "copies", F.col("page_id"))
    revisits = materialize(met.where("first <> page_id"), "revisits")
    again = F.xxhash64("page_id", "sha1")
    tested = BlockedBloom.build(revisits, again).tested(rows, again)
    known = revisits.select("page_id", "sha1").distinct()
    responses = tested.where("not possible or page_id is null").drop("possible").unionByName(tested.where("possible and page_id is not null").drop("possible").join(known, ["page_id", "sha1"], "left_anti"))
    records = responses.withColumn("first", F.lit(None).cast("long")).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    digest = F.when(revisit, F.col("sha1"))
    records.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.when(revisit, name("first")).alias("refers_to"), base32_of_hex(digest).alias("payload_digest"), "payload", F.col("size").alias("payload_bytes"),
    ).write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages; payloads are checked against their digests."""
    id_of = lambda c: F.try_to_number(F.regexp_extract(c, "^urn:page:(-?\\d+)$", 1), F.lit("S9999999999999999999")).cast("long")
    back = read_warc(spark, path, payload=True, verify=True).where(F.col("record_type").isin("response", "revisit"))
    return back.select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_of("refers_to").alias("refers_to"), "target_uri")


def round_trip(pages: DataFrame) -> DataFrame:
    path = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archive_pages(pages, path)
    return page_records(pages.sparkSession, path)
