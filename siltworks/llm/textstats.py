"""Counts over whole texts, a block of texts at a time."""

from __future__ import annotations

from collections import Counter

import numpy as np

from siltworks.llm.wordhash import Words, blocks, windows

#: The symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "top_word", "n_distinct")

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_UPPER = np.zeros(256, np.int64)
_IS_UPPER[0x41:0x5B] = 1
_IS_PUNCT = np.zeros(256, np.int64)
_IS_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 1
_IN_WORD = np.ones(256, np.int64)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0
_IN_WORD[0x80:0xC0] = 0


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _repeated(words: list[bytes], hashes: np.ndarray) -> int:
    """Words in windows found twice or more; hash matches are confirmed on the words."""
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(hashes, twice)).tolist()
    at = {i: tuple(words[i : i + REPEAT_WINDOW]) for i in places}
    found = Counter(at.values())
    cover = np.zeros(len(words) + 1, np.int64)
    for i, window in at.items():
        if found[window] > 1:
            cover[i] += 1
            cover[i + REPEAT_WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def text_counts(texts: list[bytes]) -> np.ndarray:
    """One row of COUNTS per text. bytes.isspace() and split() know the same white space as the word pattern."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for first, block in blocks(texts):
        words = Words(block)
        raw = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
        at = words.offsets[:-1]
        rows = out[first : first + len(block)]
        rows[:, 0] = np.diff(words.bounds)
        for column, kind in ((1, _IN_WORD), (2, _IS_SYMBOL), (6, _IS_UPPER), (7, _IS_PUNCT)):
            rows[:, column] = np.add.reduceat(kind[raw], at)
        eights = windows(words.hashes, REPEAT_WINDOW)
        for i, text in enumerate(block):
            rows[i, 5], rows[i, 3] = _line_counts(text)
            a, b = words.bounds[i], words.bounds[i + 1]
            if b > a:
                ordered = np.sort(words.hashes[a:b])
                edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
                runs = np.diff(edges)
                rows[i, 8], rows[i, 9] = runs.max(), len(runs)
                if rows[i, 8] > 1 and b - a > REPEAT_WINDOW:
                    own = eights[a : b - REPEAT_WINDOW + 1]
                    ordered = np.sort(own)
                    if (ordered[1:] == ordered[:-1]).any():
                        rows[i, 4] = _repeated(text.split(), own)
    return out
