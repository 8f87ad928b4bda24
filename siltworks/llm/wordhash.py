"""Vectorised word splitting and hashing over batches of texts.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes are polynomials modulo 2**64 taken
from prefix sums, then mixed; they are the same on every machine and need no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93

#: Texts are joined into blocks of about this many bytes; a longer text is a block by itself.
BLOCK_BYTES = 1 << 21

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 64)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= 1 << 23:
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: hash of each, and the bounds of each text's words."""

    __slots__ = ("bounds", "ends", "hashes", "offsets", "starts")

    def __init__(self, texts: list[bytes], lower: bool = False, hashed: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        if lower:
            raw = _LOWER[raw]
        space = _SPACE[raw]
        edge = np.empty(len(raw) + 1, bool)
        edge[0] = not space[0]
        edge[1:-1] = space[1:] != space[:-1]
        edge[-1] = False
        places = np.flatnonzero(edge)
        self.starts, self.ends = places[0::2], places[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        #: Byte offset of each text in the joined block.
        self.offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        #: Words of text i are bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.hashes = None
        if hashed:
            up, down = powers(_BYTE_BASE, len(raw) + 1)
            sums = np.empty(len(raw) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width words; runs that cross texts are the caller's to mask."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(_WORD_BASE, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1] + np.uint64(width))


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to each end."""
    up, down = powers(_WORD_BASE, len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Cut a list of texts into runs of about BLOCK_BYTES: (index of the first, texts)."""
    run: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        if run and size + len(text) > BLOCK_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in parts of a few rows, so that only so many texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoded(column) -> list[bytes]:
    """UTF-8 of a pandas column or list of texts; null is empty."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in column]
