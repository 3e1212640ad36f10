import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, licenses, mixing, passages, quality, urlfilter

from .conftest import words


def test_language_held_out_accuracy(spark):
    from gridloom.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 200 and np.mean([r.lang_pred == r.lang for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(docs, rows, nothing):
    model = langid.train(docs)
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (3, 4, 5, 6)) and not by[None].held_out
    assert by[9].lang_pred != "und"
    kept = langid.in_known_language(docs, model)
    assert kept.columns == docs.columns and {3, 4, 5, 6}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.train(nothing)["languages"] == [] and langid.predict(nothing, langid.train(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(nothing)).collect()} == {"und"}


def test_language_backoff():
    m = {"languages": ["a", "b"], "words": {"hello": np.array([-1, -5.0], np.float32)}, "grams": [{"z": np.array([-3, -1.0], np.float32)}, {"<q": np.array([-1, -4.0], np.float32)}]}
    s = langid.Scorer(m)
    assert s.predict("hello")[0] == "a" and s.predict("qqq")[0] == "a" and s.predict("z")[0] == "b" and s.predict("12")[0] == "und"


def test_quality_counts():
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)}
        lines = [x for x in text.split("\n")]
        dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
        return sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)

    for t in ("", "a b c a b c\n\n a\n a\nx # | <é>\n", "one two three one two three one two", " \n \n \n", "x\r\nx\r\nx", "a a a a a"):
        assert quality.counts(t, t.encode().split()) == brute(t)


def test_quality_model(spark, docs, rows, nothing):
    good = [(k, " ".join(words(80, k))) for k in range(60)]
    bad = [(k, " ".join(f"{w}$$$ ###" for w in words(40, k))) for k in range(60, 120)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(table, labels)
    found = {r.doc_id: r for r in quality.judge(table, model).collect()}
    assert all(found[k].kept for k in range(60)) and not any(found[k].kept for k in range(60, 120))
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found.values())
    assert quality.train(nothing, labels) is None and quality.judge(nothing, model).count() == 0
    odd = quality.judge(docs, None).collect()
    assert len(odd) == len(rows) and all(r.kept != r.base_failed and r.probability is None for r in odd)
    assert all(r.n_words == 0 and r.base_failed for r in odd if r.doc_id in (3, 4, 5))


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in fixed)
        left = sum(w[s] for s in names if s not in fixed)
        target = {s: most * sizes[s] if s in fixed else rest * w[s] / left for s in names}
        over = {s for s in names if s not in fixed and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        fixed |= over


def test_mix(docs, rows, nothing):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want, got = fill(sizes), {}
    key = {}
    for r in rows:
        key.setdefault((r[0], size(r[1])), []).append(r[3])
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        s = key[r.doc_id, r.size][0]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        got[s] = got.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(got.get(s, 0) - t) < 5
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns and again.count() > 0


def test_mixed_rows_of_null_and_repeated_ids(spark):
    """Each row's copies follow from its own source and size."""
    made = [(None, f"none {k} a b", "a") for k in range(300)] + [(k, f"some {k} a b", "a") for k in range(600)]
    made += [(5, "long " * 50 + f"x{k}", "b") for k in range(3)] + [(7, "ten " * 10, "a"), (7, "many " * 1000, "c")]
    table = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    size = lambda t: len(t.split())
    found = mixing.mixed_rows(table, (1, 1, 1)).collect()
    targets = {r.source: r.target for r in mixing.mix(table, (1, 1, 1)).join(table, "doc_id").collect() if r.size == 4 and r.source == "a"}
    got = sum(size(r.text) for r in found if r.source == "a")
    assert abs(got - targets["a"]) < 0.1 * targets["a"]
    assert {r.text for r in found if r.doc_id is None} and {r.text for r in found if r.doc_id is not None}
    copies = {}
    for r in found:
        copies[r.source, r.doc_id, r.text] = copies.get((r.source, r.doc_id, r.text), 0) + 1
    whole = {(r.doc_id, r.size, int(r.taken / r.size + 0.5)) for r in mixing.mix(table, (1, 1, 1)).where("doc_id is not null").collect()}
    assert {(i, size(t), copies.get((s, i, t), 0)) for i, t, s in made if i is not None} == whole


def test_language_of_few_documents(spark):
    """A rare language beside one with many more documents and words keeps its sample and its words."""
    r = np.random.default_rng(3)
    text = lambda mark, many: " ".join(mark * 2 + "".join(chr(97 + int(c)) for c in np.base_repr(int(v), 10)) for v in r.integers(0, many, 40))
    made = [(k, text("q", 5_000), "hot") for k in range(3000)] + [(10_000 + k, text("z", 50), "rare") for k in range(12)]
    table = spark.createDataFrame(made, "doc_id long, text string, lang string")
    model = langid.train(table, train_docs=100, most_words=100, most_grams=100)
    assert model["languages"] == ["hot", "rare"] and len(model["words"]) == 100
    own = {w for d, t, x in made if x == "rare" for w in t.split()}
    assert len(own & set(model["words"])) >= 45
    assert {x.lang_pred for x in langid.predict(table.where("lang = 'rare'"), model).collect()} == {"rare"}
    assert langid.even_share([5, 100, 100], 105) == 50 and langid.even_share([1, 2], 10) == 2


def test_licenses(spark, docs, rows, nothing):
    texts = [
        "Alpha. Released under the MIT License. beta under the mit license",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is hereby licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
        "Licensed under the Apache License, Version 2.0.",
        "the mit license under", "", None, "licence words public general gnu the",
    ]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def base(t):
        w = licenses.words_of(t)
        return [k for _, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == [x.encode() for x in p.split()]]

    for k, t in enumerate(texts):
        at, r = base(t), found[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(licenses.words_of(t)), len(at), min(at, default=None), max(at, default=None)), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert [found[k].labels for k in range(9)] == ["mit", "gpl-3", "gpl-3", "cc-by-nc", "apache-2", "", "", "", ""]
    assert found[0].base_labels == "mit" and found[1].base_labels == "" and found[1].score == 1.0 and found[6].score == 0.0
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(nothing).count() == 0


def test_urls(spark):
    urls = [
        ("http://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("https://b.org/en/1#t", "b.org", "/en/1", "org/", "allow"),
        ("ftp://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://borg/x", "borg", "/x", None, None), ("http://z.org", "z.org", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, "allow"), ("http://a.net?q=http://b.org/", "a.net", "", None, None), ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], "h") for k, u in enumerate(urls)] + [(None, urls[0][0], None)], "page_id long, url string, html string")
    found = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    assert len(found) == len(urls) + 1
    for k, (_, host, path, rule, verdict) in enumerate(urls):
        r = found[k]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    more = [(k, f"http://site{k}.org/page/{k}") for k in range(60)] + [(100 + k, f"http://casino{k}.net/win/{k}") for k in range(60)] + [(300, "http://casinowin.info/win/7"), (301, "http://site.info/page/7")]
    verdicts = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(more, "page_id long, url string")).collect()}
    assert verdicts[300] == "block" and verdicts[301] == "allow" and all(verdicts[k] == "allow" for k in range(60))
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert urlfilter.threshold_of([]) is None


def best_chain(ps, qs):
    """The best score by the quadratic recurrence."""
    order = sorted(range(len(ps)), key=lambda k: (ps[k], qs[k]))
    f = {}
    for n, k in enumerate(order):
        f[k] = max([float(passages.SEED)] + [passages.SEED + f[j] - passages.GAP_COST * (ps[k] - ps[j] + qs[k] - qs[j]) for j in order[:n] if ps[j] < ps[k] and qs[j] < qs[k]])
    return max(f.values())


def test_chains():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 25))
        links = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 40, n), r.integers(0, 40, n), strict=True)})
        ps, qs = [a for a, _ in links], [b for _, b in links]
        chains = passages.chain(ps, qs)
        assert sorted(k for c in chains for k in c) == list(range(len(ps)))
        score = lambda c: passages.SEED * len(c) - passages.GAP_COST * (ps[c[-1]] - ps[c[0]] + qs[c[-1]] - qs[c[0]])
        assert all(ps[a] < ps[b] and qs[a] < qs[b] for c in chains for a, b in zip(c, c[1:], strict=False))
        assert max(map(score, chains)) == pytest.approx(best_chain(ps, qs))


def test_passages(spark, docs, nothing):
    shared = words(80, 5, 3000)
    fuzzy = [w if k % 17 else f"x{k}" for k, w in enumerate(shared)]
    gapped = shared[:40] + ["extra", "words"] + shared[40:]
    made = [(1, words(100, 11, 3000) + shared + words(60, 12, 3000)), (2, words(30, 13, 3000) + fuzzy + words(10, 14, 3000)), (3, gapped), (4, words(300, 15, 3000)), (5, shared[:30] + words(100, 16, 3000))]
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in made] + [(6, None), (None, " ".join(shared))], "doc_id long, text string")
    found = passages.passages(table).collect()
    best = {r.doc_id: r for r in sorted(found, key=lambda r: r.same_words)}
    assert set(best) == {2, 3}
    assert best[2].ref_id == 1 and abs(best[2].start_word - 30) <= 3 and abs(best[2].end_word - 110) <= 3 and abs(best[2].ref_start - 100) <= 3
    assert best[3].ref_id == 1 and best[3].same_words >= 78 and best[3].end_word - best[3].start_word >= 80
    assert passages.passages(nothing).count() == 0
    assert passages.passages(docs).count() >= 55


def test_passages_whose_pieces_came_before(spark):
    """Two documents share a passage, and earlier ones hold pieces too short to be passages."""
    made = []
    for k in range(12):
        shared = words(60, 700 + k, 100_000)
        around = lambda middle, n, k=k: words(50, 800 + 10 * k + n, 100_000) + middle + words(50, 900 + 10 * k + n, 100_000)
        other = [w if i % 9 != 4 or k % 2 else f"y{i}" for i, w in enumerate(shared)]  # word for word or changed
        made += [(1000 * k + n, " ".join(around(w, n))) for n, w in enumerate((shared[:40], shared[20:], shared, other))]
        made += [(1000 * k + 4, " ".join(words(50, 850 + k, 100_000)))]
    found = {(r.doc_id, r.ref_id) for r in passages.passages(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert {(1000 * k + 3, 1000 * k + 2) for k in range(12)} <= found


def test_passages_recall(spark):
    """From 45 words on and 0.8 alike, against pairs that are known to share a passage."""
    r = np.random.default_rng(4)
    ways = {f"{n}, every {k}": (n, lambda n, k=k: set(range(k - 1, n - 1, k))) for n, k in ((45, 5), (60, 6), (60, 8), (60, 10), (100, 10))}
    ways |= {f"{n}, at random": (n, lambda n: set(r.choice(np.arange(4, n - 4), int(n * 0.19), replace=False).tolist())) for n in (45, 60, 100)}
    made, of = [], {}
    for name, (n, change) in ways.items():
        for _ in range(25):
            k = len(made)
            shared = words(n, 5000 + k, 100_000)
            at = change(n)
            for m, w in enumerate((shared, [f"x{k}-{i}" if i in at else w for i, w in enumerate(shared)])):
                made.append((k + m, " ".join(words(80, 6000 + 3 * (k + m), 100_000) + w + words(80, 6001 + 3 * (k + m), 100_000))))
            of[k + 1] = name
    found = {x.doc_id for x in passages.passages(spark.createDataFrame(made, "doc_id long, text string").repartition(8)).collect()}
    share = {name: sum(d in found for d, x in of.items() if x == name) / 25 for name in ways}
    assert all(v == 1 for name, v in share.items() if "every" in name) and min(share.values()) >= 0.8, share
