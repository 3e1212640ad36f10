"""Token files: ids in patched frame-of-reference blocks.

A file holds the documents of a range of ids, ascending. Its ids are one stream, cut into blocks of BLOCK numbers. A block
subtracts its minimum and packs the rest at a width that PERCENTILE of its numbers fit in; the others, outliers, have their low
bits packed and their high bits in an exception list. An index of block starts lets a reader decode any range of ids alone.

Layout, little-endian: magic 'GLPF', u32 version, u64 documents, u64 ids, u64 blocks; document table (i64 doc_id, u64 ids in
it); per block u32 minimum, u8 width, u16 exceptions; block index (u64 start of each block's data, and the end); the data of
each block: packed low bits, then u16 positions and u32 high bits of its exceptions.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, stored, task_count
from .tokens import encoder, vocabulary_path

MAGIC, VERSION = b"GLPF", 1
BLOCK = 1024
PERCENTILE = 97
HEAD = struct.Struct("<4sIQQQ")
#: A file is closed at so many ids, so that reading one back takes bounded memory.
FILE_IDS = 2_000_000
END_ID = 2


def _turns(blocks: np.ndarray, size: int = 128) -> list[np.ndarray]:
    """Blocks in turns, so that the arrays of a turn stay small."""
    return [blocks[at : at + size] for at in range(0, len(blocks), size)]


def _lanes(width: int) -> list[tuple[int, int, int]]:
    """Eight numbers fill `width` bytes. For each: its place, the 64-bit lane that it begins in, and its shift there."""
    return [(k, k * width >> 6, k * width & 63) for k in range(8)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) numbers below 2 ** width -> (blocks, BLOCK * width / 8) bytes."""
    eights = values.reshape(-1, 8).astype(np.uint64)
    lanes = np.zeros((-(-width // 8) + 1, len(eights)), np.uint64)
    for k, lane, shift in _lanes(width):
        lanes[lane] |= eights[:, k] << np.uint64(shift)
        if shift + width > 64:
            lanes[lane + 1] |= eights[:, k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(lanes.T).view(np.uint8)[:, :width].reshape(len(values), -1)


def _unpack(data: np.ndarray, width: int) -> np.ndarray:
    padded = np.zeros((data.size // width, 8 * (-(-width // 8) + 1)), np.uint8)
    padded[:, :width] = data.reshape(-1, width)
    lanes = np.ascontiguousarray(padded.view(np.uint64).T)
    out = np.empty((len(padded), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k, lane, shift in _lanes(width):
        found = lanes[lane] >> np.uint64(shift)
        if shift + width > 64:
            found |= lanes[lane + 1] << np.uint64(64 - shift)
        out[:, k] = found & mask
    return out.reshape(len(data), -1)


def encode_file(doc_ids: list[int], documents: list[bytes]) -> bytes:
    """documents: ids of each as unsigned 32-bit numbers."""
    ids = np.frombuffer(b"".join(documents), np.uint32)
    blocks = -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if blocks:
        padded[len(ids) :] = ids[-1]
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = padded - low[:, None]
    wide = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100] if blocks else low
    width = np.ceil(np.log2(wide.astype(np.float64) + 1)).astype(np.uint8)
    outlier = rest >> width[:, None].astype(np.uint32) > 0
    exceptions = outlier.sum(axis=1).astype(np.uint16) if blocks else np.empty(0, np.uint16)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        for chosen in _turns(np.flatnonzero(width == w)):
            packed = _pack(rest[chosen] & np.uint32((1 << int(w)) - 1), int(w))
            for k, row in zip(chosen.tolist(), packed, strict=True):
                body[k] = row.tobytes()
    for k in np.flatnonzero(exceptions):
        places = np.flatnonzero(outlier[k]).astype(np.uint16)
        body[k] += places.tobytes() + (rest[k, places] >> np.uint32(width[k])).astype("<u4").tobytes()
    index = np.zeros(blocks + 1, np.uint64)
    index[1:] = np.cumsum([len(x) for x in body])
    table = np.empty(len(doc_ids), [("doc_id", "<i8"), ("n", "<u8")])
    table["doc_id"], table["n"] = doc_ids, [len(x) // 4 for x in documents]
    head = np.empty(blocks, [("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
    head["low"], head["width"], head["exceptions"] = low, width, exceptions
    return b"".join([HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), blocks), table.tobytes(), head.tobytes(), index.astype("<u8").tobytes(), *body])


class Reader:
    """A file's documents; ids(a, b) decodes only the blocks that hold them."""

    def __init__(self, data: bytes):
        magic, version, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEAD.size
        self.table = np.frombuffer(data, [("doc_id", "<i8"), ("n", "<u8")], docs, at)
        at += self.table.nbytes
        self.head = np.frombuffer(data, [("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")], blocks, at)
        at += self.head.nbytes
        self.index = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.data, self.body = data, at + self.index.nbytes

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Blocks first to last - 1, decoded."""
        out = np.empty((last - first, BLOCK), np.uint32)
        head = self.head[first:last]
        raw = np.frombuffer(self.data, np.uint8)
        starts = self.body + self.index[first:last]
        for w in np.unique(head["width"]):
            size = BLOCK * int(w) // 8
            for chosen in _turns(np.flatnonzero(head["width"] == w)):
                out[chosen] = _unpack(raw[starts[chosen][:, None] + np.arange(size)], int(w)) if w else 0
        for k in np.flatnonzero(head["exceptions"]):
            n, at = int(head["exceptions"][k]), int(starts[k]) + BLOCK * int(head["width"][k]) // 8
            places = np.frombuffer(self.data, "<u2", n, at)
            high = np.frombuffer(self.data, "<u4", n, at + 2 * n)
            out[k, places] |= high << np.uint32(head["width"][k])
        return out + head["low"][:, None]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        found = self.blocks(first, -(-stop // BLOCK)).ravel()
        return found[start - first * BLOCK : stop - first * BLOCK]


def put_file(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that is lost leaves no half file, and one that runs again replaces it with the same."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def _write(folder: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        end = struct.pack("<I", END_ID)
        ids: list[int] = []
        documents: list[bytes] = []
        held = total = count = 0
        done = []

        def close():
            nonlocal ids, documents, held, count
            name = f"tokens-{part:06d}-{count:05d}.glpf"
            put_file(f"{folder}/{name}", encode_file(ids, documents))
            done.append((part, name, ids[0], len(ids), held))
            ids, documents, held, count = [], [], 0, count + 1

        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                for doc, data in zip(batch.column(0)[at : at + 256].to_pylist(), encode(texts[at : at + 256].to_pylist()), strict=True):
                    ids.append(doc)
                    documents.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= FILE_IDS:
                        close()
        if ids:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "first_id", "documents", "ids"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write the ids of docs (each with END_ID after it) to files in folder, in ascending doc_id order over all files, and
    return the catalogue of files: part, file, first_id, documents, ids, start (ids in all files before).

    Null texts are empty: their END_ID alone. Null doc_ids come first, as -2 ** 63. Rows that repeat a doc_id stand one after
    the other. An empty table makes an empty catalogue.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(4 * task_count(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(rows.mapInArrow(_write(folder, tokenizer or vocabulary_path()), "part int, file string, first_id long, documents long, ids long"), "catalogue")
    # a row for each file of millions of ids: small enough for one task, and for the driver of any corpus that has a path for each file
    from pyspark.sql import Window

    order = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data, start in zip(*(batch.column(k) for k in range(3)), strict=True):
            reader = Reader(memoryview(data.as_buffer()))
            sizes = reader.table["n"].astype(np.int64)
            ends = np.cumsum(sizes)
            raw = reader.ids().astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(reader.table["doc_id"].astype(np.int64)), pa.array(start.as_py() + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, catalogue: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32. Spark broadcasts
    the catalogue while it is below the session's threshold, and joins by file name beyond it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.glpf").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = found.join(catalogue.select("file", "start"), "file").select("file", "content", "start")
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token files to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    catalogue = stored(write_tokens(docs, folder, tokenizer), "catalogue")
    if catalogue.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, catalogue).withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
