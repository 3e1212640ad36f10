import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, exact_dedup, near_dedup
from gridloom.llm.exact_dedup import BloomFilter, Memtable, compact


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def exact_brute(rows):
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            by[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        sha = hashlib.sha256(norm(r[1]).encode()).hexdigest()
        ids = by[norm(r[1])]
        out.append((r[0], r[0] and min(ids), len(ids) if r[0] else 1, r[0] is None or r[0] == min(ids), sha))
    return Counter(out)


def result(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_matches_brute_force(docs, rows):
    assert result(exact_dedup.exact_dedup(docs, memtable_rows=7)) == exact_brute(rows)


def test_weak_digest_is_verified(docs, rows):
    """Digests of one byte collide; the bytes tell the texts apart."""
    weak = lambda t: F.substring(exact_dedup.sha256(t), 1, 2)
    assert result(exact_dedup.exact_dedup(docs, weak, 1, memtable_rows=5)) == exact_brute(rows)


def test_distinct_rows(docs, rows):
    kept = exact_dedup.distinct_rows(docs)
    assert kept.columns == docs.columns
    assert Counter((r[0], norm(r[1])) for r in kept.collect()) == Counter({(k[0], norm(t)): 1 for k in exact_brute(rows) if k[0] is not None and k[3] for t in {r[1] for r in rows if r[0] == k[0] and hashlib.sha256(norm(r[1]).encode()).hexdigest() == k[4]}}) + Counter((None, norm(r[1])) for r in rows if r[0] is None)


def test_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert near_dedup.near_dedup(nothing).count() == 0
    assert exact_dedup.distinct_rows(nothing).count() == near_dedup.near_distinct(nothing).count() == 0


def test_runs_and_filters():
    digests = [hashlib.sha256(str(k % 50).encode()).digest() for k in range(80)]
    runs = []
    for part in (range(0, 30), range(30, 80)):
        m = Memtable(1)
        m.put([digests[k] for k in part], list(part))
        row = m.flush().to_pylist()[0]
        runs.append((np.frombuffer(row["digests"], ">u8").astype(np.uint64).reshape(-1, 4), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), BloomFilter.unpack(row["filter"])))
    assert all(BloomFilter.build(runs[0][0]).may_hold(runs[0][0]))
    words, ids, counts = compact(runs)
    assert sorted(ids) == list(range(30)) and set(counts) == {2}


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows):
    docs = {r[0]: shingles(r[1]) for r in rows if r[0] is not None and r[0] != 8}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            both = len(docs[a] & docs[b])
            if a < b and both and 100 * both >= 85 * len(docs[a] | docs[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(docs[i]), find(i), find(i) == i) for i in docs}


def test_near_matches_brute_force(docs, rows):
    found = near_dedup.near_dedup(docs).collect()
    assert len(found) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in found if r[0] not in (None, 8)} == near_brute(rows)
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert near_dedup.near_distinct(docs).columns == docs.columns


@pytest.mark.parametrize("block", [3, 1000])
def test_blocks_do_not_matter(docs, rows, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    assert {r[0]: tuple(r)[1:] for r in near_dedup.near_dedup(docs).collect() if r[0] not in (None, 8)} == near_brute(rows)


def test_intersections():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 300, r.integers(1, 80)).astype(np.uint64)) for _ in range(150)]
    total = near_dedup.intersections(sets)
    for i in range(150):
        for j in range(150):
            if i != j:
                assert total[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_keys_hold_every_pair_within_the_distance():
    import pyarrow as pa

    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 16, 48).astype(np.uint16)
    for _ in range(50):
        b = a.copy()
        b[r.choice(48, near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1, replace=False)] ^= 1
        out = next(near_dedup._keys(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "signature": [a.tobytes(), b.tobytes()]})])))
        keys = defaultdict(set)
        for k, d in zip(out["key"].to_pylist(), out["doc_id"].to_pylist(), strict=True):
            keys[k].add(d)
        assert any(len(x) == 2 for x in keys.values())


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(200, 100), (100, 150), (7, 7), (None, 3), (300, 301), (301, 300)] + [(500, 500 + k) for k in range(1, 300)]
    found = {r[0]: r[1] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 1 for k in range(1, 61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300} | {500 + k: 500 for k in range(300)}
    assert found == want
