"""Token ids by a public tokenizer file, with a cache of words.

A file of the kind of word_bpe_49k.json (lower-casing, one split pattern, byte-level BPE) never joins text across white space and treats every
piece between white space by itself, so ids of a text are the ids of its pieces in order. Pieces repeat; each distinct one
is encoded once per worker while the cache holds it. In texts of ASCII and Latin-1, pieces are cut by the
tokenizer's own pattern and go to its BPE model directly; pieces of other texts go through the tokenizer whole. A file that is set up in any
other way encodes whole texts without these short cuts.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import regex

# The set-up of the files whose texts may be cut at white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
_PATTERN = regex.compile(_SPLIT)
#: What str.split() would split on beside ASCII white space, and the opening of special strings.
_SPLITS = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")
#: Control bytes and the soft hyphen, which go through the tokenizer whole.
_ODD = re.compile("[\x00-\x1f\x7f-\xa0\xad]")
_LATIN = re.compile("[\x00-\xff]*")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def _byte_alphabet() -> list[str]:
    """Byte-level BPE writes each byte as a printable character: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Pieces(dict):
    """Ids of each piece between white space, made on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.make(piece)
        return got


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_pieces = self._knows(path)
        self.cache_words = cache_words
        self.alphabet = _byte_alphabet()
        self.pieces = _Pieces(self._piece)
        self.odd_pieces = _Pieces(self.whole)

    @staticmethod
    def _knows(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in told.get("added_tokens") or [])
        return special and told["model"]["type"] == "BPE" and all(told.get(k) == v for k, v in _KNOWN.items())

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = "".join(map(self.alphabet.__getitem__, part.encode()))
        ids = [t.id for t in self.model.tokenize(part)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """piece: lower-cased Latin-1 without white space. Its parts are pieces too, so each word is encoded once."""
        if piece.isalpha():
            return self._part(piece)
        if piece[:-1].isalpha() and piece[-1] in ".,":
            return self.pieces[piece[:-1]] + self.pieces[piece[-1]]
        if _ODD.search(piece):
            return self.whole(piece)
        parts = _PATTERN.findall(piece)
        return self._part(piece) if parts == [piece] else b"".join(map(self.pieces.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        if not self.by_pieces:
            return self.whole(text)
        for cache in (self.pieces, self.odd_pieces):
            if len(cache) > self.cache_words:
                cache.clear()
        if text.isascii() or _LATIN.fullmatch(text):
            if not any(map(text.__contains__, _SPLITS)):
                return b"".join(map(self.pieces.__getitem__, text.lower().split()))
        return b"".join(map(self.odd_pieces.__getitem__, _ASCII_SPACE.split(text)))

    def array(self, text: str) -> np.ndarray:
        return np.frombuffer(self.ids(text), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
