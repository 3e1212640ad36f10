"""What the operators share: places that every executor sees, word bytes and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a new local one if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. bytes.split() splits at exactly SPACE and bytes.lower() maps A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_clear: dict[str, Callable] = {}


def begin(owner: str, clear: Callable) -> None:
    """A Python worker serves one operator after another. The one that begins empties what the others hold, so that their caches do not add up."""
    for other, f in list(_clear.items()):
        if other != owner:
            f()
            del _clear[other]
    _clear[owner] = clear


class Recent(dict):
    """The entries of late: when there are `limit`, they become the older ones, and those that were older go. So its memory is
    bounded, and what comes again and again stays."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.old = {}


class WordHashes(Recent):
    """Word to its 64-bit hash; as a dict, since most words come again."""

    def __missing__(self, word: bytes) -> int:
        h = self.old.get(word)
        if h is None:
            h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        self.turn()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The worker's word hashes, for all operators that need them.
word_hashes = WordHashes(100_000)


def hash_words() -> WordHashes:
    begin("words", word_hashes.clear)
    return word_hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit numbers: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BLOCK = 1 << 15
_ODD = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_VALUE[65:91] = _VALUE[97:123]
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK - 1, _ODD, np.uint64)])
_BACK = np.cumprod(np.r_[np.uint64(1), np.full(_BLOCK - 1, pow(_ODD, -1, 1 << 64), np.uint64)])


def text_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hashes of words_of(text), in order, without a dict: a word's is a polynomial over its bytes, the difference of two
    running sums, shifted back to the word's start. The sums begin anew after _BLOCK bytes; a longer word has a hash of its own."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
    blank = np.r_[True, _BLANK[data], True]
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        end = int(np.searchsorted(ends, first + _BLOCK, "right"))
        if end == at:
            out[at] = xxhash.xxh3_64_intdigest(data[first : ends[at]].tobytes().lower())
            at += 1
            continue
        part = _VALUE[data[first : ends[end - 1]]]
        part *= _POWER[: len(part)]
        sums = np.r_[np.uint64(0), np.cumsum(part)]
        left, right = starts[at:end] - first, ends[at:end] - first
        out[at:end] = mix((sums[right] - sums[left]) * _BACK[left])
        at = end
    return out


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive words, in order; none where there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + n])
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles, ascending; with fewer than k words the whole sequence is one; none without words."""
    if len(hashes) == 0:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes, min(k, len(hashes))))


def source_key(column) -> F.Column:
    """A text for grouping and joining by a nullable string: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))
