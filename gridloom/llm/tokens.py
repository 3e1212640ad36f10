"""Token ids of whole texts as packed bytes, by the tokenizers library with a cache of pieces."""

from __future__ import annotations

import json
import re
import struct

import public_tokenizers

from .common import Recent, begin

WORD_BPE = "word_bpe_49k.json"
#: The steps before the model that Encoder splits texts by itself for. A file with others goes to the library whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The letters, numbers and white space below U+0180, once texts are in lower case; the rules' pattern over them.
LETTERS, NUMBERS, BLANKS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")
#: Characters beyond those, and the one whose lower case is two.
ODD = re.compile("[İƀ-\U0010ffff]")
WORDS = re.compile(f"[^{BLANKS}]+")
LONGEST_KEPT = 64


def _printable() -> dict[int, str]:
    """Byte-level vocabularies write the bytes that do not print, in order, as the characters from U+0100 on."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in stay)}


PRINTABLE = _printable()


def vocabulary_path(name: str = WORD_BPE) -> str:
    return public_tokenizers.path(name)


class Pieces(Recent):
    """A piece, or an odd word, to its ids."""

    def __init__(self, library, limit: int):
        super().__init__(limit)
        self.library, self.tokenize = library, library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            if piece.isascii() and piece.isprintable():
                ids = [t.id for t in self.tokenize(piece)]
            elif ODD.search(piece):
                ids = self.library.encode(piece, add_special_tokens=False).ids
            else:
                ids = [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(PRINTABLE))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = found
        return found


class Encoder:
    """Texts to ids, each an unsigned little-endian 32-bit number.

    Where a file's steps are NORMALIZER and PRE_TOKENIZER, white space goes and nothing joins across pieces, so a text's ids are
    those of its pieces one after the other. The library's model encodes each new piece once; what comes again is found in a
    cache of bounded size. Words with ODD characters go through all of the library's steps, and so do whole texts that may name
    special tokens, and all texts of any other file.
    """

    LIMIT = 250_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.by_pieces = (rules["normalizer"], rules["pre_tokenizer"], rules["model"]["type"], rules["model"].get("dropout")) == (NORMALIZER, PRE_TOKENIZER, "BPE", None)
        self.by_pieces &= all(t["content"].startswith("<|") for t in rules["added_tokens"])
        self.pieces = Pieces(self.library, self.LIMIT)

    def _whole(self, texts: list[str]) -> list[bytes]:
        """By all of the library's steps."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _text(self, text: str) -> bytes:
        if "<|" in text:
            return self._whole([text])[0]
        if not ODD.search(text):
            split = PIECES.findall(text.lower())
        else:
            split = [p for w in WORDS.findall(text) for p in ([w] if ODD.search(w) else PIECES.findall(w.lower()))]
        return b"".join(map(self.pieces.__getitem__, split))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_pieces:
            return self._whole([t or "" for t in texts])
        out = []
        for text in texts:
            self.pieces.turn()
            out.append(self._text(text) if text else b"")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; the caches of other operators are emptied."""
    begin("tokens", lambda: [e.pieces.clear() for e in _encoders.values()])
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
