"""Section containers: one file of named, tagged, compressed payloads with a JSON index in front.

Framing, little-endian: magic (4 bytes, the last a version), u32 data version, u32 header length, JSON header (format_version,
app, sections with kind, name, tags, version, offset, size), then each payload compressed with zstd. As a Spark data source,
`sections`: reading plans from the index alone, takes filters on kind and name before any payload is touched, and deals
payloads out by size; writing compresses in the tasks and joins their parts at commit, under another name until it is whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..errors import NotFound, ParseFailure

MAGIC = b"GLS\x01"
LEVEL = 3
SCHEMA = "kind string, name string, tags array<string>, version int, payload binary"
RAW_SCHEMA = SCHEMA + ", raw binary, raw_size long"
PART_BYTES = 64 << 20


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), os.path.abspath(path))


def compress(payload: bytes) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(payload, asbytes=True)


def decompress(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(blob)


def read_header(path: str, magic: bytes = MAGIC) -> tuple[dict, int, int]:
    """Header, data version and where payloads begin. Raises ParseFailure on another magic, a newer version or a cut file."""
    fs, local = _fs(path)
    try:
        with fs.open_input_file(local) as f:
            head = f.read(12)
            if len(head) < 12 or head[:3] != magic[:3]:
                raise ParseFailure(f"{path} is no section container")
            if head[3] > magic[3]:
                raise ParseFailure(f"{path} has version {head[3]}, newer than {magic[3]}")
            data_version, size = int.from_bytes(head[4:8], "little"), int.from_bytes(head[8:12], "little")
            text = f.read(size)
    except FileNotFoundError as e:
        raise NotFound(path) from e
    if len(text) < size:
        raise ParseFailure(f"{path} ends in its header")
    return json.loads(text), data_version, 12 + size


def write_frame(path: str, app, data_version: int, entries: list[dict], blobs: Iterator[bytes], magic: bytes = MAGIC) -> None:
    """entries carry `size`; blobs are streamed in their order."""
    offset = 0
    for e in entries:
        e["offset"] = offset
        offset += e["size"]
    header = json.dumps({"format_version": magic[3], "app": app, "sections": entries}).encode()
    fs, local = _fs(path)
    fs.create_dir(os.path.dirname(local), recursive=True)
    part = f"{local}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(magic + data_version.to_bytes(4, "little") + len(header).to_bytes(4, "little") + header)
        for blob in blobs:
            out.write(blob)
    fs.move(part, local)


class _Range(InputPartition):
    def __init__(self, entries: list[dict], start: int):
        self.entries, self.start = entries, start


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.names = options["path"], [f.name for f in schema]
        self.magic = options["magic"].encode("latin-1") if "magic" in options else MAGIC
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("kind",), ("name",)):
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[_Range]:
        header, _, start = read_header(self.path, self.magic)
        fits = lambda e: all(e[f.attribute[0]] == f.value if isinstance(f, EqualTo) else e[f.attribute[0]] in f.value for f in self.wanted)
        parts, now, held = [], [], 0
        for e in filter(fits, header["sections"]):
            now.append(e)
            held += e["size"]
            if held >= PART_BYTES:
                parts.append(_Range(now, start))
                now, held = [], 0
        return [*parts, _Range(now, start)] if now or not parts else parts

    def read(self, partition: _Range) -> Iterator[tuple]:
        fs, local = _fs(self.path)
        with fs.open_input_file(local) as f:
            for e in partition.entries:
                row = {"kind": e["kind"], "name": e["name"], "tags": e.get("tags", []), "version": e.get("version", 0), "raw_size": e["size"]}
                if "payload" in self.names or "raw" in self.names:
                    f.seek(partition.start + e["offset"])
                    row["raw"] = f.read(e["size"])
                    row["payload"] = decompress(row["raw"]) if "payload" in self.names else None
                yield tuple(row.get(n) for n in self.names)


class _Part(WriterCommitMessage):
    def __init__(self, path: str, entries: list[dict]):
        self.path, self.entries = path, entries


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema, overwrite: bool):
        self.options, self.names = dict(options), [f.name for f in schema]

    def write(self, rows) -> _Part:
        fs, local = _fs(self.options["path"])
        path, entries = f"{local}.{uuid.uuid4().hex}.blobs", []
        fs.create_dir(os.path.dirname(local), recursive=True)
        with fs.open_output_stream(path) as out:
            for row in rows:
                r = row.asDict()
                blob = bytes(r["raw"]) if r.get("raw") is not None else compress(bytes(r["payload"] or b""))
                out.write(blob)
                entries.append({"kind": r["kind"], "name": r["name"], "tags": list(r.get("tags") or []), "version": r.get("version") or 0, "size": len(blob)})
        return _Part(path, entries)

    def commit(self, messages: list[_Part | None]) -> None:
        fs, _ = _fs(self.options["path"])
        parts = [m for m in messages if m is not None]

        def blobs():
            for p in parts:
                with fs.open_input_stream(p.path) as f:
                    while data := f.read(8 << 20):
                        yield data

        write_frame(self.options["path"], json.loads(self.options.get("app", "null")), int(self.options.get("dataversion", self.options.get("dataVersion", 0))), [e for p in parts for e in p.entries], blobs(), self.options["magic"].encode("latin-1") if "magic" in self.options else MAGIC)
        self.abort(messages)

    def abort(self, messages: list[_Part | None]) -> None:
        fs, _ = _fs(self.options["path"])
        for m in messages:
            if m is not None:
                fs.delete_file(m.path)


class SectionSource(DataSource):
    """spark.read.format("sections").load(path); schema RAW_SCHEMA also gives the compressed bytes."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SectionSource)


def write_sections(df: DataFrame, path: str, app=None, data_version: int = 0) -> None:
    """df: kind, name, tags, version, payload (or raw: compressed bytes, written as they are)."""
    register(df.sparkSession)
    df.write.format("sections").option("app", json.dumps(app)).option("dataVersion", str(data_version)).mode("overwrite").save(path)


def read_sections(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("sections").schema(RAW_SCHEMA.replace("payload binary, ", "") if raw else SCHEMA).load(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The index: kind, name, tags, version, raw_size; no payload is read."""
    register(spark)
    return spark.read.format("sections").schema("kind string, name string, tags array<string>, version int, raw_size long").load(path)


def app_of(path: str):
    return read_header(path)[0].get("app")


def read_section(spark: SparkSession, path: str, name: str) -> bytes:
    row = read_sections(spark, path).where(F.col("name") == name).select("payload").first()
    if row is None:
        raise NotFound(f"{path} has no section {name!r}")
    return bytes(row[0])


def filter_to(spark: SparkSession, source: str, target: str, keep) -> None:
    """The sections for which the column `keep` holds, their bytes as they were, with the source's app."""
    header, version, _ = read_header(source)
    write_sections(read_sections(spark, source, raw=True).where(keep), target, header.get("app"), version)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sections of both; of those with one kind and name b's."""
    return a.join(b.select("kind", "name"), ["kind", "name"], "left_anti").select(a.columns).unionByName(b)


def merge_to(spark: SparkSession, a: str, b: str, target: str) -> None:
    header, version, _ = read_header(a)
    write_sections(merged(read_sections(spark, a, raw=True), read_sections(spark, b, raw=True)), target, header.get("app"), version)
