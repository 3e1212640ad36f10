"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is LINEAR * n + QUADRATIC * n * n, as attention within a document grows with its square. In a
group of documents, pieces that fill a sequence are cut off first; the rest goes, in descending order, to the sequence of the
lowest cost that has room for it. A rest that fits nowhere whole is cut: it fills the sequences of the lowest cost that have
room. A group opens as many sequences as its tokens fill, and for what is left over sequences of powers of two, which are not
padded; so no token of padding remains.

A group is what a task has read up to GROUP_TOKENS, so packing needs no shuffle, and its memory is bounded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, vocabulary_path

LENGTH = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1 / 1024
GROUP_TOKENS = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, length: int) -> list[int]:
    """Room of the sequences that `total` tokens fill to the last: whole ones, then the powers of two of what is left."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Sizes of documents (each positive) -> pieces (document, start, length, sequence, offset); every sequence is full."""
    pieces: list[tuple[int, int, int, int, int]] = []
    rests: list[tuple[int, int]] = []
    sequence = 0
    for doc, n in enumerate(sizes):
        whole = n - n % length
        for start in range(0, whole, length):
            pieces.append((doc, start, length, sequence, 0))
            sequence += 1
        if n > whole:
            rests.append((n - whole, doc))
    rests.sort(key=lambda x: (-x[0], x[1]))
    room = np.array(capacities(sum(n for n, _ in rests), length), np.int64)
    limit, load = room.copy(), np.zeros(len(room))

    def put(doc: int, start: int, n: int, k: int) -> None:
        pieces.append((doc, start, n, sequence + k, int(limit[k] - room[k])))
        room[k] -= n
        load[k] += cost(n) if room[k] else np.inf  # a full sequence is no longer a choice

    for n, doc in rests:
        start, end = sizes[doc] - n, sizes[doc]
        fits = np.where(room >= n, load, np.inf)
        k = int(fits.argmin())
        if fits[k] < np.inf:
            put(doc, start, n, k)
            continue
        while start < end:
            k = int(load.argmin())
            n = min(end - start, int(room[k]))
            put(doc, start, n, k)
            start += n
    return pieces


def _pack_batches(tokenizer: str, length: int, group_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer).encode
        end = struct.pack("<I", END_ID)
        ids: list[int | None] = []
        data: list[bytes] = []
        held, sequence = 0, TaskContext.get().partitionId() << 40

        def group():
            nonlocal ids, data, held, sequence
            found = pack([len(x) // 4 for x in data], length)
            found.sort()
            rows = [(ids[d], s, n, zlib.crc32(data[d][4 * s : 4 * (s + n)]), len(data[d]) // 4, sequence + q, o) for d, s, n, q, o in found]
            sequence += 1 + max(q for *_, q, _ in found)
            ids, data, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for doc, found in zip(batch.column(0)[at : at + 256].to_pylist(), encode(batch.column(1)[at : at + 256].to_pylist()), strict=True):
                    ids.append(doc)
                    data.append(found + end)
                    held += len(found) // 4 + 1
                    if held >= group_tokens:
                        yield group()
        if data:
            yield group()

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document of its own, so rows that repeat a doc_id are all packed, each with its own pieces. Null and
    empty texts are the end id alone. Null doc_ids stay null. An empty table gives none; other columns are not read.
    sequence_id is unique over all tasks (task in its high bits), not gapless.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_batches(tokenizer or vocabulary_path(), length, group_tokens), SCHEMA)
