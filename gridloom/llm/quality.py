"""Quality rules: counts of a text, and a logistic regression over hashed word and character n-grams with calibrated probabilities.

The regression learns from labelled rows (quality 1 or 0): the counts of words and of CHARS-byte n-grams, hashed to DIMENSIONS
each, damped by log(1 + n) and scaled to length one. Of the labelled rows one in four is set aside; a logistic curve fitted to
them turns scores into probabilities (Platt's method). Texts are scored in Arrow batches and kept from KEEP_FROM on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, word_hashes

#: Documented bound of the model: about so many labelled rows are taken, by hash of their id.
TRAIN_ROWS = 4_000
DIMENSIONS = 1 << 16
CHARS = 4
KEEP_FROM = 0.5
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text with these words."""
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            repeated += line in seen
            seen.add(line)
    n_repeat = 0
    if len(words) >= 3:
        _, back, often = np.unique(gram_hashes(word_hashes.of(words), 3), return_inverse=True, return_counts=True)
        twice = (often > 1)[back]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        n_repeat = int(covered.sum())
    return len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), repeated, n_repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def features(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text that occur and their weights: words below DIMENSIONS, byte n-grams from there on."""
    at = (word_hashes.of(words) >> np.uint64(20)) & np.uint64(DIMENSIONS - 1)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(raw) - CHARS + 1
    if n > 0:
        gram = np.zeros(n, np.uint32)
        for k in range(CHARS):
            gram = gram * np.uint32(0x01000193) + raw[k : k + n]
        gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        at = np.concatenate([at, ((gram >> np.uint32(16)) + DIMENSIONS).astype(np.uint64)])
    if not len(at):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    at, often = np.unique(at, return_counts=True)
    weight = np.log1p(often).astype(np.float32)
    return at.astype(np.int32), weight / np.float32(np.sqrt((weight * weight).sum()))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hash_words()
    for batch in batches:
        found = []
        for t in batch.column(0):
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            found.append(features(data, data.split()))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary()), batch.column(1), batch.column(2)], ["at", "weight", "quality", "aside"])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120, rate: float = 8.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; classes weigh the same."""
    at = np.concatenate([a for a, _ in rows])
    weight = np.concatenate([w for _, w in rows])
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    share = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels == 0).sum()))
    w, bias = np.zeros(2 * DIMENSIONS), 0.0
    ahead, ahead_bias = w.copy(), bias
    for step in range(steps):
        z = np.bincount(owner, weight * ahead[at], len(rows)) + ahead_bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
        new = ahead - rate * (np.bincount(at, weight * error[owner], len(w)) + decay * ahead)
        new_bias = ahead_bias - rate * error.sum()
        speed = step / (step + 3)
        ahead, ahead_bias = new + speed * (new - w), new_bias + speed * (new_bias - bias)
        w, bias = new, new_bias
    return w.astype(np.float32), float(bias)


def calibrate(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to scores, by Newton steps on damped labels."""
    up, down = (labels > 0).sum(), (labels == 0).sum()
    goal = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        v = p * (1 - p)
        g = np.array([((p - goal) * scores).sum(), (p - goal).sum()])
        h = np.array([[(v * scores * scores).sum() + 1e-6, (v * scores).sum()], [(v * scores).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -2, 2)), b - float(np.clip(move[1], -2, 2))
        if np.abs(move).max() < 1e-9:
            break
    return max(a, 1e-3), b


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict | None:
    """The model from the rows of docs that have a label; None unless both labels occur (then every text passes)."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality"))
    n = marked.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1_000_003))
    chosen = marked.where(place < 1_000_003 * min(1.0, train_rows / max(1, n)))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(chosen, "_id")
    found = rows.select("text", F.col("quality").cast("int").alias("quality"), (F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(4)) == 0).alias("aside")).mapInArrow(_featured, "at binary, weight binary, quality int, aside boolean").collect()
    data = [(np.frombuffer(r.at, np.int32), np.frombuffer(r.weight, np.float32)) for r in found]
    quality, aside = np.array([r.quality for r in found], float), np.array([r.aside for r in found], bool)
    order = sorted(range(len(data)), key=lambda k: (quality[k], found[k].at, found[k].weight))  # the same model whatever the order of rows
    learn, check = [k for k in order if not aside[k]], [k for k in order if aside[k]]
    if len({*quality[learn]}) < 2:
        return None
    w, bias = fit([data[k] for k in learn], quality[learn])
    if len({*quality[check]}) < 2:
        check = learn
    scores = np.array([float(data[k][1] @ w[data[k][0]]) + bias for k in check])
    slope, offset = calibrate(scores, quality[check])
    return {"w": w, "bias": bias, "slope": slope, "offset": offset}


_models: dict[str, dict | None] = {}


def judge(docs: DataFrame, model: dict | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability for each row of docs.

    Null and empty texts have no words and fail the base rules. Without a model the probability is null and the base rules
    decide alone. Rows that repeat are judged each, a null doc_id stays null, an empty table gives none, and columns other
    than doc_id and text are not read.
    """
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_words()
        if key not in _models:
            _models.clear()
            _models[key] = shared.value
        m = _models[key]
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for t in batch.column(1):
                text = t.as_py() or ""
                data = text.encode("utf-8", "surrogatepass")
                words = data.split()
                found = counts(text, words)
                failed = base_failed(len(words), found[3])
                p = None
                if m is not None:
                    at, weight = features(data, words)
                    z = m["slope"] * (float(weight @ m["w"][at]) + m["bias"]) + m["offset"]
                    p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                for c, v in zip(columns, (len(words), *found, failed, not failed and (p is None or p >= keep_from), p), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")
