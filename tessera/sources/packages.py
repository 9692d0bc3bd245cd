"""Ingestion packages: ZIP archives of a manifest and two files of JSON lines, and a store keyed by content."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The members of a package and the limits of its sizes.
MEMBERS = ["manifest.json", "pessoas.jsonl", "registros.jsonl"]
ZIPPED, UNZIPPED, MANIFEST = 250 << 20, 2 << 30, 64 << 10
#: Bytes of lines in a batch.
BATCH_BYTES = 4 << 20
SCHEMA = "path string, sha256 string, member string, line_no long, line string, problem string"
SHAPE = pa.schema([("path", pa.string()), ("sha256", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("line", pa.string()), ("problem", pa.string())])


def problem_of(content: bytes) -> str | None:
    if len(content) > ZIPPED:
        return "TOO_LARGE"
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return "NO_ZIP"
    if sorted(i.filename for i in infos) != sorted(MEMBERS):
        return "MEMBERS"
    if sum(i.file_size for i in infos) > UNZIPPED or next(i.file_size for i in infos if i.filename == MEMBERS[0]) > MANIFEST:
        return "TOO_LARGE"
    return None


def _member_batches(z: zipfile.ZipFile, member: str, head: dict) -> Iterator[pa.RecordBatch]:
    """Lines that are not blank, numbered from 0, inflated as they are read; the manifest is one line."""
    rows, size, n = [], 0, 0
    with z.open(member) as stream:
        for raw in [stream.read()] if member == MEMBERS[0] else stream:
            line = raw.decode("utf-8").rstrip("\n") if member != MEMBERS[0] else raw.decode("utf-8")
            if member != MEMBERS[0] and not line.strip():
                continue
            rows.append(head | {"member": member, "line_no": n, "line": line})
            n, size = n + 1, size + len(raw)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, SHAPE)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, SHAPE)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each line of each member; a package with a problem gives one row that names it."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                head = {"path": f["path"], "sha256": f["sha256"]}
                problem = problem_of(f["content"])
                if problem:
                    yield pa.RecordBatch.from_pylist([head | {"problem": problem}], SHAPE)
                    continue
                with zipfile.ZipFile(io.BytesIO(f["content"])) as z:
                    for member in MEMBERS:
                        yield from _member_batches(z, member, head)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInArrow(lines, SCHEMA)


def write_package(path: str, members: dict[str, str]) -> None:
    """The same members give the same bytes: fixed order, times and attributes."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name in MEMBERS:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), members[name], zipfile.ZIP_DEFLATED)


def orphans(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Stored content (sha256) that nothing refers to."""
    return stored.join(referenced.select("sha256").distinct(), "sha256", "left_anti")
