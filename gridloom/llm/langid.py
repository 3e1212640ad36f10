"""Language identification by word-first backoff.

A known word scores each language by the log of its smoothed relative frequency there. An unseen word is backed off to its
character n-grams (with marks at its ends): the longest n for which some n-gram is known decides, from LONGEST down to one
character. A text's score for a language is the sum over its words; the prediction is the best, its score the posterior
probability under equal priors (of mean scores a word, so that long texts do not all score one).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, stored

#: Documented bounds of the model: training documents at most about so many (drawn by hash), words and n-grams at most so many.
TRAIN_DOCS = 20_000
MOST_WORDS, MOST_GRAMS = 100_000, 60_000
LONGEST = 4
UNKNOWN = "und"
#: The pipeline rejects predictions below this score, and texts without a letter.
LEAST_SCORE = 0.5
#: A word is a run of letters (Unicode category L), for training in the JVM and for scoring alike.
LETTERS = r"\p{L}+"
WORDS = regex.compile(LETTERS)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 4; null without a doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def _grams(word: Column, n: int) -> Column:
    marked = F.concat(F.lit("<"), word, F.lit(">")) if n > 1 else word
    return F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substr(marked, i, F.lit(n))))


def even_share(have: list[int], total: int) -> float:
    """The most that each may give, where those with less give all, for a sum of total."""
    left, many = float(total), len(have)
    for n in sorted(have):
        if n * many >= left:
            return left / many
        left, many = left - n, many - 1
    return float(max(have, default=0))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> dict:
    """The model from text and lang of the rows of docs that are not held out, have a doc_id and a lang.

    Where there are more than train_docs of them, those of the lowest hashes are taken, to about that number: of each language
    as many as of any other, or all that it has. Languages without a word are not learned. Words and n-grams are those of the
    best rank by frequency in some language (ties by the frequency in all, then by text), so the model's size is bounded and no
    language's words give way to a larger one's.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    have = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(have.values()) > train_docs:
        each = even_share(list(have.values()), train_docs)
        cut = F.create_map(*[F.lit(v) for x, n in have.items() for v in (x, math.ceil(1_000_003 * min(1.0, each / n)))])
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.element_at(cut, F.col("lang")))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = stored(words, "words")
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)

    def tables(counted: DataFrame, key: str, most: int) -> dict[str, list[float]]:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))
        counted = counted.select("lang", "n", key, rank.alias("_rank"))
        top = counted.groupBy(key).agg(F.min("_rank").alias("_best"), F.sum("n").alias("_all"), *[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"_{k}") for k, x in enumerate(languages)])
        return {r[0]: list(r[3:]) for r in top.orderBy("_best", F.desc("_all"), key).limit(most).collect()}

    # words seen once are left to their n-grams
    known = tables(words.join(words.groupBy("w").agg(F.sum("n").alias("_s")).where("_s > 1"), "w"), "w", most_words) if languages else {}
    grams = []
    for size in range(1, LONGEST + 1):
        counted = words.select("lang", "n", F.explode(_grams(F.col("w"), size)).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n"))
        grams.append(tables(counted, "g", most_grams) if languages else {})
    log = lambda counts, totals, size: np.log((np.array(counts, float) + 0.1) / (np.array(totals, float) + 0.1 * (size + 1))).astype(np.float32)
    model = {"languages": languages, "words": {w: log(c, [totals[x] for x in languages], len(known)) for w, c in known.items()}, "grams": []}
    for table in grams:
        sums = np.sum([*table.values(), [0] * len(languages)], axis=0)
        model["grams"].append({g: log(c, sums, len(table)) for g, c in table.items()})
    return model


def packed(model: dict) -> dict:
    """The model with a Table for each of its dicts, as workers hold it."""
    n = len(model["languages"])
    return {"languages": model["languages"], "words": Table.build(model["words"], n), "grams": [Table.build(g, n) for g in model["grams"]]}


class Table:
    """Texts to rows of scores: 64-bit hashes in ascending order and a matrix, so a table of any vocabulary takes two arrays."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        self.hashes, self.rows = hashes, rows

    @staticmethod
    def hash(texts: list[str]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))

    @classmethod
    def build(cls, rows: dict[str, np.ndarray], n: int) -> Table:
        hashes = cls.hash(list(rows))
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], np.array([*rows.values()], np.float32).reshape(len(rows), n)[order])

    def find(self, texts: list[str]) -> np.ndarray:
        """For each text its row, or -1."""
        if not len(self.hashes):
            return np.full(len(texts), -1)
        wanted = self.hash(texts)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


class Scorer:
    """Rows of scores by word; words that come again are looked up. What it holds is emptied at a set size."""

    LIMIT = 100_000

    def __init__(self, model: dict):
        self.model, self.n = model if isinstance(model["words"], Table) else packed(model), len(model["languages"])
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, self.n), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The scores of words: of the word if it is known, else the mean of its longest known n-grams, else zero."""
        out = np.zeros((len(words), self.n), np.float32)
        found = self.model["words"].find(words)
        out[found >= 0] = self.model["words"].rows[found[found >= 0]]
        left = np.flatnonzero(found < 0)
        for size in range(len(self.model["grams"]), 0, -1):
            texts = [f"<{words[k]}>" if size > 1 else words[k] for k in left.tolist()]
            grams = [t[k : k + size] for t in texts for k in range(len(t) - size + 1)]
            owner = np.repeat(np.arange(len(left)), [max(0, len(t) - size + 1) for t in texts])
            found = self.model["grams"][size - 1].find(grams)
            owner, found = owner[found >= 0], found[found >= 0]
            many = np.bincount(owner, minlength=len(left))
            total = np.zeros((len(left), self.n))
            np.add.at(total, owner, self.model["grams"][size - 1].rows[found])
            some = many > 0
            out[left[some]] = total[some] / many[some, None]
            left = left[~some]
        return out

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        words = WORDS.findall(text.lower())
        try:
            rows = list(map(self.at.__getitem__, words))
        except KeyError:
            if len(self.at) > self.LIMIT:
                self.reset()
            new = [w for w in dict.fromkeys(words) if w not in self.at]
            first = len(self.at)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = self.rows(new)
            self.at.update(zip(new, range(first, first + len(new)), strict=True))
            rows = list(map(self.at.__getitem__, words))
        return self.table[rows].sum(axis=0, dtype=np.float64), len(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.n:
            return UNKNOWN, 0.0
        total, n = self.scores(text)
        if not n:
            return UNKNOWN, 0.0
        mean = total / n * math.sqrt(min(n, 64))
        e = np.exp(mean - mean.max())
        best = int(mean.argmax())
        return self.model["languages"][best], float(min(1.0, e[best] / e.sum()))


_scorers: dict[str, Scorer] = {}


def scorer(key: str, shared) -> Scorer:
    """The worker's scorer of a broadcast model; one at a time."""
    begin("langid", _scorers.clear)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(shared.value)
    return _scorers[key]


def _predict(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer(key, shared).predict
        for batch in batches:
            found = [predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    lang_pred is `und` and the score 0 where the text is null, empty or has no letter, or nothing was learned. Equal scores go
    to the first language in order. Without a doc_id, held_out is false. Rows that repeat are predicted each; an empty table
    gives none; columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(uuid.uuid4().hex, spark.sparkContext.broadcast(packed(model))), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def in_known_language(docs: DataFrame, model: dict | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs, all columns, that have a letter and a prediction of at least `least`."""
    spark = docs.sparkSession
    model = train(docs) if model is None else model
    shape, key = docs.schema, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = scorer(key, shared).predict
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [(p := predict(t.as_py()))[0] != UNKNOWN and p[1] >= least for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, shape)
