"""License scans by diagonal voting.

Templates are license phrases and notices. Every run of GRAM words of every text is hashed and joined with the template
positions that hold the same run; a match votes for the diagonal (text position - template position). Diagonals next to each
other are merged, so that an inserted or left-out word does not split a notice. A merged span is then verified on the words
themselves. A base phrase needs all its words in a row; a notice needs a longest common subsequence of its words that covers
COVERED of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, stored, word_hashes

#: Phrases whose every place counts (n_base).
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Notices of the method's own labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)
GRAM = 3
#: Diagonals at most so far apart are merged; a notice is verified if so much of it is found in order.
GAP, COVERED = 3, 0.8
#: A notice is looked at if this part of its runs voted.
VOTED = 0.4
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HEADER = 0


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())


def templates() -> list[tuple[str, list[bytes], bool]]:
    """(label, words, base) of all phrases and notices."""
    return [(label, words_of(t), True) for label, t in BASE] + [(label, words_of(t), False) for label, t in NOTICES]


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, template, at, need): a row for each run of words of each template, and one that lets header rows through. Its
    size is that of the constants above, whatever the input, so it may be broadcast."""
    rows = [(_HEADER, -1, 0, 0)]
    for t, (_, words, base) in enumerate(templates()):
        grams = gram_hashes(word_hashes.of(words), GRAM).view(np.int64).tolist()
        rows += [(g, t, k, len(grams) if base else max(1, int(VOTED * len(grams)))) for k, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, at int, need int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text_id, text) -> a header row (gram 0, pos: number of words) and a row for each run of GRAM words."""
    hash_words()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids, texts = np.asarray(part.column(0)), np.asarray(part.column(1))
            found, places, sizes = [], [], []
            for t in part.column(2):
                words = words_of(t.as_py())
                grams = gram_hashes(word_hashes.of(words), GRAM).view(np.int64)
                grams = np.where(grams == _HEADER, 1, grams)
                found += [np.array([_HEADER]), grams]
                places += [np.array([len(words)]), np.arange(len(grams))]
                sizes.append(1 + len(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(texts, sizes)), pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["_id", "_text_id", "gram", "pos"]
            )


def in_order(text: list[bytes], template: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(template) + 1)
    for w in text:
        left = 0
        for k, t in enumerate(template, 1):
            up = row[k]
            row[k] = left + 1 if w == t else max(up, row[k - 1])
            left = up
    return row[-1]


def verify(text: str, spans: list) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """spans: (template, lowest and highest diagonal). n_base, first and last base place, base labels, own labels, score."""
    words, known = words_of(text), templates()
    places: set[tuple[int, int]] = set()
    base, own, score = set(), set(), 0.0
    for t, low, high in spans:
        label, wanted, is_base = known[t]
        if is_base:
            for d in range(max(0, low), high + 1):
                if words[d : d + len(wanted)] == wanted:
                    places.add((t, d))
                    base.add(label)
        else:
            a, b = max(0, low), high + len(wanted)
            share = in_order(words[a:b], wanted) / len(wanted)
            if share >= COVERED:
                own.add(label)
                score = max(score, share)
    starts = [d for _, d in places]
    return len(places), min(starts, default=None), max(starts, default=None), base, own, 1.0 if base else score


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(2), batch.column(3), strict=True):
            n, first, last, base, own, score = verify(text.as_py() or "", [(s["template"], s["low"], s["high"]) for s in spans.as_py()])
            rows.append((n, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["_id", "_text_id", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. Null texts are empty:
    no words, no labels (empty strings), score 0. score is 1 with a base phrase, else the best covered part of a notice that
    was verified. Rows that repeat a doc_id and its text get one result each; rows with a null doc_id keep it. An empty table
    gives none; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a row is told by its doc_id and a hash of both; rows that share them have one result
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(id_.alias("_id"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("_text_id"), text.alias("text"))
    hits = rows.mapInArrow(_grams, "_id long, _text_id long, gram long, pos int").join(F.broadcast(template_grams(spark)), "gram")
    hits = stored(hits.select("_id", "_text_id", "template", "pos", "need", (F.col("pos") - F.col("at")).alias("diagonal")), "hits")
    headers = hits.where("template = -1").select("_id", "_text_id", F.col("pos").cast("long").alias("n_words"))
    votes = hits.where("template >= 0").groupBy("_id", "_text_id", "template", "need", "diagonal").agg(F.count_distinct("pos").alias("votes"))
    order = Window.partitionBy("_id", "_text_id", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > GAP
    merged = votes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(order))
    spans = merged.groupBy("_id", "_text_id", "template", "need", "_span").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes")).where("votes >= need")
    spans = stored(spans.groupBy("_id", "_text_id").agg(F.collect_list(F.struct("template", "low", "high")).alias("spans")), "spans")
    texts = rows.join(spans, ["_id", "_text_id"]).select("_id", "_text_id", "text", "spans")
    verified = stored(texts.mapInArrow(_verify, "_id long, _text_id long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").dropDuplicates(["_id", "_text_id"]), "verified")
    out = headers.join(verified, ["_id", "_text_id"], "left")
    return out.select(
        F.nullif("_id", F.lit(-(2**63))).alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
