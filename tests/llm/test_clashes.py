"""Rows that repeat a doc_id, and columns whose names the operators use inside."""

from collections import Counter

import pytest

from gridloom.llm import exact_dedup, langid, mixing, near_dedup

from .conftest import words
from .test_dedup import norm, shingles


def near_rows():
    base, far = words(120, 1), words(90, 2, 5000)
    copy = [*base[:60], "new", *base[61:]]
    second = [*copy[:20], "other", *copy[21:]]
    out = [(3, base), (8, copy), (8, far), (9, [*far[:40], "x", *far[41:]]), (10, second), (10, second), (11, words(60, 3, 5000)), (11, words(60, 4, 5000)), (12, []), (12, [])]
    out += [(20 + k, [*base[: 30 + k], *(f"n{j}" for j in range(k)), *base[30 + 2 * k :]]) for k in range(1, 9)]
    return [(i, " ".join(w)) for i, w in out]


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2, 768])
def test_near_dedup_of_repeated_ids(spark, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, _id string, _row string, node int").repartition(3)
    want = near_brute(rows)
    assert Counter(tuple(r) for r in near_dedup.near_dedup(docs).collect()) == Counter(want)
    stays = near_dedup.near_distinct(docs)
    assert stays.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in stays.collect())
    assert set(kept) <= {rows[k] for k, w in enumerate(want) if w[3]} and all(n == 1 or i == 12 for (i, _), n in kept.items())
    assert {i for i, _ in kept} == {w[0] for w in want if w[3]} and (8, rows[2][1]) in kept and (8, rows[1][1]) not in kept


def test_recall_on_documents(spark):
    """Queries: ids divisible by 50, against all rows; every link of theirs is found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links and all(found[a] == found[b] for a, b in links)


def test_clashing_columns(spark):
    names = ["_key", "_copy", "_times", "_row", "_id", "_source", "_norm", "size"]
    made = [(1, "a  b", "s"), (2, "a b", "s"), (None, "a b", "s"), (3, None, None), (4, "c d e f", "t")]
    docs = spark.createDataFrame([(*r, *[f"{n}{k}" for n in names]) for k, r in enumerate(made)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    kept = exact_dedup.distinct_rows(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r._key, norm(r.text)) for r in kept.collect()} == {(1, "_key0", "a b"), (None, "_key2", "a b"), (3, "_key3", ""), (4, "_key4", "c d e f")}
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {(r._copy, r._times) for r in mixed.collect()} <= {(f"_copy{k}", f"_times{k}") for k in range(5)}


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ", "en"), (3, "one two", "en"), (4, "eins zwei", "de"), (5, "一二", "zh"), (6, "一二", "zh"), (7, "一二", "zh")], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert found[1].lang_pred == "und" and found[1].score == 0
    assert found[3].lang_pred == "en" and found[5].lang_pred == "zh"
