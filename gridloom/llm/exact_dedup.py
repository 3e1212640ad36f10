"""Exact dedup by a log-structured merge index.

Each task fills a memtable (digest -> smallest id, number of rows). A full memtable is flushed as sorted runs, one for each
range of digests, each with a Bloom filter. Compaction merges the runs of a range: it asks the filters which entries other runs
may hold, merges those, and keeps the smallest id and the total of each digest. Only digests of two rows or more go to the
compacted index; a row whose digest is in it is a hit, and its bytes are compared with the text of the row that stays. Hits
that differ although their digests agree are grouped anew by digest and text, so even a weak digest gives right results.

A memtable holds a digest once, so a group of copies of any size makes one entry in a run, and ranges of a digest are even.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, task_count

RUNS = "shard int, n long, digests binary, ids binary, counts binary, filter binary"
MERGED = "digest binary, keep_id long, entries long"
#: Rows of a digest range that one compaction task should hold.
RANGE_ROWS = 500_000
MEMTABLE_ROWS = 200_000
FILTER_BITS, FILTER_HASHES = 10, 4


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"[{SPACE}]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class BloomFilter:
    """Bits set at positions taken from the digests themselves, which are evenly spread."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def positions(digests: np.ndarray, size: int) -> np.ndarray:
        """digests: (n, 4) unsigned 64-bit words."""
        a, b = digests[:, 2], digests[:, 3] | np.uint64(1)
        return np.stack([(a + np.uint64(i) * b) % np.uint64(size) for i in range(FILTER_HASHES)])

    @classmethod
    def build(cls, digests: np.ndarray) -> BloomFilter:
        bits = np.zeros(max(64, -(-len(digests) * FILTER_BITS // 8) * 8), np.uint8)
        bits[cls.positions(digests, len(bits)).ravel()] = 1
        return cls(bits)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        return self.bits[self.positions(digests, len(self.bits))].all(axis=0)

    def pack(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> BloomFilter:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8)))


def _words(digests: list[bytes] | np.ndarray) -> np.ndarray:
    """Digests of up to 32 bytes as rows of four big-endian words, so that their order is that of the bytes."""
    joined = b"".join(x.ljust(32, b"\0") for x in digests)
    return np.frombuffer(joined, ">u8").astype(np.uint64).reshape(-1, 4)


def _order(words: np.ndarray) -> np.ndarray:
    return np.lexsort((words[:, 3], words[:, 2], words[:, 1], words[:, 0]))


def _reduce(words: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by digest, one entry for each: the smallest id and the sum of counts."""
    if len(words) == 0:
        return words, ids, counts
    o = _order(words)
    words, ids, counts = words[o], ids[o], counts[o]
    starts = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
    return words[starts], np.minimum.reduceat(ids, starts), np.add.reduceat(counts, starts)


class Memtable:
    """Entries that a task has not flushed yet."""

    def __init__(self, shards: int, limit: int = MEMTABLE_ROWS):
        self.shards, self.limit, self.entries = shards, limit, {}

    def put(self, digests: list[bytes], ids: list[int]) -> None:
        entries = self.entries
        for d, i in zip(digests, ids, strict=True):
            if (old := entries.get(d)) is None:
                entries[d] = (i, 1)
            else:
                entries[d] = (min(old[0], i), old[1] + 1)

    @property
    def full(self) -> bool:
        return len(self.entries) >= self.limit

    def flush(self) -> pa.RecordBatch:
        """The entries as sorted runs, one for each range of digests."""
        values = list(self.entries.values())
        words, ids, counts = _reduce(_words(list(self.entries)), np.array([v[0] for v in values], np.int64), np.array([v[1] for v in values], np.int64))
        self.entries = {}
        shard = (words[:, 0] >> np.uint64(32)).astype(np.int64) * self.shards >> 32 if len(words) else np.empty(0, np.int64)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([s for s, _, _ in rows], pa.int32()),
                "n": pa.array([int(b - a) for _, a, b in rows], pa.int64()),
                "digests": pa.array([words[a:b].astype(">u8").tobytes() for _, a, b in rows], pa.binary()),
                "ids": pa.array([ids[a:b].tobytes() for _, a, b in rows], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for _, a, b in rows], pa.binary()),
                "filter": pa.array([BloomFilter.build(words[a:b]).pack() for _, a, b in rows], pa.binary()),
            }
        )


def compact(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, BloomFilter]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run of the digests that stand for two rows or more, from runs of one range. The filters leave out what a single run holds."""
    chosen = []
    for i, (words, ids, counts, _) in enumerate(runs):
        wanted = counts > 1
        for j, other in enumerate(runs):
            if i != j and not wanted.all():
                rest = np.flatnonzero(~wanted)
                wanted[rest] = other[3].may_hold(words[rest])
        chosen.append((words[wanted], ids[wanted], counts[wanted]))
    words, ids, counts = _reduce(*(np.concatenate([c[k] for c in chosen]) for k in range(3)))
    several = counts > 1
    return words[several], ids[several], counts[several]


def _flush_runs(shards: int, memtable_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable = Memtable(shards, memtable_rows)
        for batch in batches:
            memtable.put(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if memtable.full:
                yield memtable.flush()
        if memtable.entries:
            yield memtable.flush()

    return run


def _compact_shards(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(runs):
            words, ids, counts = compact(runs)
            data = words.astype(">u8").tobytes()
            return pa.RecordBatch.from_pydict(
                {"digest": pa.array([data[32 * k : 32 * k + width] for k in range(len(words))], pa.binary()), "keep_id": pa.array(ids, pa.int64()), "entries": pa.array(counts, pa.int64())}
            )

        shard, runs = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and runs:
                    yield merged(runs)
                    runs = []
                shard = row["shard"]
                runs.append((np.frombuffer(row["digests"], ">u8").astype(np.uint64).reshape(-1, 4), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), BloomFilter.unpack(row["filter"])))
        if runs:
            yield merged(runs)

    return run


def build_index(entries: DataFrame, width: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(digest binary, id long) -> the compacted index of repeated digests: digest, keep_id, entries (rows of that digest)."""
    spark = entries.sparkSession
    parts = task_count(spark)
    shards = max(parts, -(-entries.count() // RANGE_ROWS))
    runs = entries.mapInArrow(_flush_runs(shards, memtable_rows), RUNS)
    return runs.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(_compact_shards(width), MERGED)


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, width: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Rows without a doc_id take no part: keep_id null, group_size 1, kept true. Rows that repeat a
    doc_id and its text all carry it as keep_id and count in group_size; all of them say kept (see distinct_rows). Rows that
    repeat a doc_id with other texts are judged one by one. An empty table gives none. Columns other than doc_id and text are
    not read. digest: hexadecimal digest of a text column, of `width` bytes.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_norm"))
    keyed = rows.select("doc_id", sha256(F.col("_norm")).alias("text_sha256"), F.unhex(digest(F.col("_norm"))).alias("_digest"))
    keyed = stored(keyed, "digests")
    index = stored(build_index(keyed.where("doc_id is not null").select(F.col("_digest").alias("digest"), F.col("doc_id").alias("id")), width, memtable_rows), "lsm")
    probed = stored(keyed.join(index, F.col("_digest") == F.col("digest"), "left").select("doc_id", "text_sha256", "_digest", "keep_id"), "probed")
    alone = probed.where("keep_id is null or doc_id is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = probed.where("keep_id is not null and doc_id is not null")
    # byte verification: the texts of hits against the text of the row that stays; rows are told apart by id and full hash
    hit_ids = hits.select("doc_id").distinct()
    texts = rows.join(hit_ids, "doc_id", "left_semi").withColumn("_digest", F.unhex(digest(F.col("_norm"))))
    stays = stored(texts.join(index, [texts._digest == index.digest, texts.doc_id == index.keep_id]).groupBy("keep_id", "digest").agg(F.min("_norm").alias("_stays")), "stays")
    checked = texts.join(stays.withColumnRenamed("digest", "_digest"), "_digest")
    checked = stored(checked.select("doc_id", "_digest", "keep_id", (F.col("_norm") == F.col("_stays")).alias("same"), sha256(F.col("_norm")).alias("text_sha256"), F.when(F.col("_norm") != F.col("_stays"), F.col("_norm")).alias("_other")), "verified")
    same = checked.where("same")
    sizes = stored(same.groupBy("_digest").agg(F.count("*").alias("group_size")), "sizes")
    verified = same.join(sizes, "_digest").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    other = checked.where("not same")
    regrouped = other.groupBy("_digest", "_other").agg(F.min("doc_id").alias("_keep"), F.count("*").alias("group_size"))
    mended = other.join(regrouped, ["_digest", "_other"]).select("doc_id", F.col("_keep").alias("keep_id"), "group_size", (F.col("doc_id") == F.col("_keep")).alias("kept"), "text_sha256")
    return alone.unionByName(verified).unionByName(mended)


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs without the copies, all columns: for each text the row with the smallest doc_id. Rows without a doc_id stay."""
    found = exact_dedup(docs)
    stays = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_hash")).distinct()
    # the row as one column, so that its own columns may have any names
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), sha256(normalised(docs["text"])).alias("_key"))
    named = keyed.join(stays, [F.col("_doc") == F.col("_id"), F.col("_key") == F.col("_hash")], "left_semi").dropDuplicates(["_doc", "_key"])
    return named.unionByName(keyed.where("_doc is null")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
