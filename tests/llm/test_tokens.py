import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridloom.llm import packing, pfor
from gridloom.llm.common import text_hashes, words_of
from gridloom.llm.tokens import Encoder, vocabulary_path

ODD = ["don't, I'll. it's: x.y 3.5! Ⅷ. é. É!! é. İa. ΑΣ. foo<|endoftext|>bar a b \x1c x\x1fy <|ENDOFTEXT|> ª. º, Größe$$$ ÑANDÚ### naïve* l'été", "", None, " \n ", "a" * 3000, "ĳ ŉ ſ ǆ ß ẞ", "...!!! $$$ #a# a#b c*d", "日本語。text", "Áb é.", "x" * 50 + "!" * 50]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path())


def plain(encoder, texts):
    return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_is_the_library(encoder, rows, monkeypatch):
    texts = ODD + [r[1] for r in rows]
    want = plain(encoder, texts)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts) == want
    monkeypatch.setattr(Encoder, "LIMIT", 20)
    small = Encoder(vocabulary_path())
    for _ in range(3):
        assert small.encode(texts) == want


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("kind", ["flat", "small", "spikes", "wide"])
def test_pfor_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"flat": np.full(n, 7), "small": r.integers(5, 40, n), "spikes": np.where(r.random(n) < 0.02, 2**32 - 1, r.integers(0, 9, n)), "wide": r.integers(0, 2**32, n)}[kind].astype(np.uint32)
    cuts = sorted(r.integers(0, n + 1, 4).tolist())
    docs = [x.astype("<u4").tobytes() for x in np.split(ids, cuts)]
    reader = pfor.Reader(pfor.encode_file(list(range(5)), docs))
    assert reader.table["n"].tolist() == [len(d) // 4 for d in docs]
    assert (reader.ids() == ids).all()
    a, b = n // 3, n // 2
    assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        pfor.Reader(b"XXXX" + bytes(40))


def test_files(docs, rows, encoder, nothing, monkeypatch):
    monkeypatch.setattr(pfor, "FILE_IDS", 3000)
    found = pfor.token_output(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    tokens = [x + struct.pack("<I", 2) for x in encoder.encode([r[1] for r in ordered])]
    starts = np.cumsum([0, *[len(t) // 4 for t in tokens]])
    want = [(r[0], int(s), len(t) // 4, zlib.crc32(t)) for r, s, t in zip(ordered, starts, tokens, strict=False)]
    assert sorted(tuple(r)[1:] for r in found) == sorted(w[1:] for w in want)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    assert pfor.token_output(nothing).count() == 0


@pytest.mark.parametrize("length", [16, 2048])
def test_pack_fills_every_sequence(length):
    r = np.random.default_rng(3)
    sizes = [*r.integers(1, 3 * length, 200).tolist(), 1, length, length, 2 * length, 5]
    pieces = packing.pack(sizes, length)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n))
    for doc, size in enumerate(sizes):
        at = 0
        for start, n in sorted(by_doc[doc]):
            assert start == at and n > 0
            at += n
        assert at == size
    for found in by_sequence.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0


def test_pack_balances_cost():
    sizes = np.random.default_rng(1).integers(20, 900, 4000).tolist()
    load = defaultdict(float)
    for _, _, n, sequence, _ in packing.pack(sizes):
        load[sequence] += packing.cost(n)
    full = sorted(load.values())[12:]
    assert np.std(full) < 0.15 * np.mean(full)


def test_pack_documents(docs, rows, encoder, nothing):
    found = packing.pack_documents(docs, group_tokens=4000).collect()
    tokens = [x + struct.pack("<I", 1) for x in encoder.encode([r[1] for r in rows])]
    assert sum(r.length for r in found) == sum(len(t) // 4 for t in tokens)
    by_id = {r[0]: t for r, t in zip(rows, tokens, strict=True) if r[0] not in (None, 8)}
    for r in found:
        if r.doc_id in by_id:
            t = by_id[r.doc_id]
            assert zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens == len(t) // 4
    totals = defaultdict(int)
    for r in found:
        totals[r.sequence_id] += r.length
    assert all(t <= 2048 for t in totals.values())
    assert packing.pack_documents(nothing).count() == 0


def test_word_hashes_of_texts():
    """Equal words have equal hashes wherever they stand, and other words have others; words longer than a block as well."""
    texts = [None, "", " \n", "a", " A\x0bb c\n", "\ud800 q é É", "x" * 40_000 + " Ab " + "y " * 40_000 + "X" * 40_000, "ab ba aab " * 9]
    seen: dict[bytes, int] = {}
    for text in texts:
        words, hashes = words_of(text), text_hashes(text)
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes.tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
