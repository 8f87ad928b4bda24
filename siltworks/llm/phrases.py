"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed greedily into phrases, each the shortest run not seen before in that text; the set of phrases
stands for what a compressor would learn from it. The set is hashed into a minimum-hash signature (one permutation, BINS bins, 16
bits of each bin's least hash), and the share of equal bins estimates the likeness of two sets. Code points are the alphabet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.wordhash import mix, powers
from siltworks.session import scratch, ship_package

BINS = 128
_EMPTY = 0xFFFF
_BASE = 0xA24BAED4963EE407
#: Documents of one task of the pass over neighbours, and tasks at most (they take more documents beyond that: two texts at a time are held).
DOCS_PER_TASK, MOST_TASKS = 4000, 20_000


class Parser:
    """The dictionary of one text as a tree; ends are the phrase ends so far."""

    __slots__ = ("ends", "node", "root")

    def __init__(self) -> None:
        self.root: dict = {}
        self.node = self.root
        self.ends: list[int] = []

    def feed(self, text: str, at: int, log: list | None = None) -> None:
        """Parse on from offset at; log gets what was added, so that it can be taken back."""
        root, node, ends = self.root, self.node, self.ends
        for i, c in enumerate(text, at + 1):
            below = node.get(c)
            if below is None:
                if log is not None:
                    log.append((node, c))
                node[c] = {}
                node = root
                ends.append(i)
            else:
                node = below
        self.node = node


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The minimum-hash signature of the phrases of text that end at ends."""
    out = np.full(BINS, _EMPTY, np.uint16)
    if not ends:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    up, down = powers(_BASE, len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    last = np.array(ends)
    first = np.concatenate(([0], last[:-1]))
    hashes = mix((sums[last] - sums[first]) * down[first])
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (hashes & np.uint64(BINS - 1)).astype(np.int64), hashes >> np.uint64(7))
    full = least != np.iinfo(np.uint64).max
    out[full] = (least[full] % np.uint64(_EMPTY)).astype(np.uint16)
    return out


def phrase_signature(text: str) -> np.ndarray:
    parser = Parser()
    parser.feed(text, 0)
    return signature(text, parser.ends)


def edited_text(text: str, following: str) -> str:
    """text with its last third replaced by the first as many code points of the following one."""
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


def both_signatures(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of a text and of its edited text; the part that they share is parsed once."""
    cut = len(text) - len(text) // 3
    edited = edited_text(text, following)
    parser = Parser()
    parser.feed(text[:cut], 0)
    node, n = parser.node, len(parser.ends)
    log: list = []
    parser.feed(text[cut:], cut, log)
    own = signature(text, parser.ends)
    for place, c in reversed(log):
        del place[c]
    parser.node, parser.ends = node, parser.ends[:n]
    parser.feed(edited[cut:], cut)
    return own, signature(edited, parser.ends), edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either fills; two empty sets are alike."""
    some = (a != _EMPTY) | (b != _EMPTY)
    n = int(some.sum())
    return float(((a == b) & some).sum() / n) if n else 1.0


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u2").astype(np.uint16)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row, where it is scanned; null text counts as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_text(phrase_signature(t or "")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STREAM = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string())]
)


def _compare(doc_id: int | None, text: str, following: str) -> dict:
    own, changed, edited = both_signatures(text, following)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "own": own,
        "edited_fingerprint": as_text(changed),
        "near_edited": likeness(own, changed),
    }


def _finish(row: dict, following: np.ndarray) -> dict:
    own = row.pop("own")
    return row | {"fingerprint": as_text(own), "near_next": likeness(own, following)}


def edit_robustness(docs: DataFrame) -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text (see edited_text; the following document is the next by descending doc_id, after
    the last the first), and the likeness of its fingerprint to the edited text's and to the following document's.

    Null text is empty. Null doc_ids come last in order; rows of equal doc_id, null or not, follow by a hash of the text and then by the text. Repeated
    rows follow each other. A single row follows itself; an empty table gives no rows. Texts are parsed whole, however long. Other columns of
    docs are ignored, whatever their names. Rows are dealt by ranges of that order and streamed, two texts at a time; only the first and last
    text of each range meet in a second step.
    """
    n = docs.count()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(min(MOST_TASKS, max(1, -(-n // DOCS_PER_TASK))), *order[:2]).sortWithinPartitions(*order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before: tuple | None = None
        held: dict | None = None
        for batch in batches:
            out: list[dict] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if before is None:
                    out.append({"doc_id": doc_id, "text": text, "kind": 1, "part": part})
                else:
                    row = _compare(*before, text)
                    if held is not None:
                        out.append(_finish(held, row["own"]) | {"kind": 0})
                    held = row
                before = (doc_id, text)
            yield pa.RecordBatch.from_pylist(out, _STREAM)
        if before is not None:
            out = [_finish(held, phrase_signature(before[1])) | {"kind": 0}] if held is not None else []
            out.append({"doc_id": before[0], "text": before[1], "kind": 2, "part": part})
            yield pa.RecordBatch.from_pylist(out, _STREAM)

    ship_package(docs.sparkSession)
    streamed = scratch(ranged.mapInArrow(stream, _RESULT + ", kind int, part long, text string"), "phrases")
    names = [c.split(" ")[0] for c in _RESULT.split(", ")]
    firsts = streamed.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    parts = streamed.where("kind = 1").select("part")
    after = Window.orderBy("part")
    ring = parts.select("part", F.coalesce(F.lead("part").over(after), F.min("part").over(after)).alias("next_part"))
    ends = streamed.where("kind = 2").select("doc_id", "text", "part").join(ring, "part").join(firsts, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _finish(_compare(r["doc_id"], r["text"], r["next_text"]), phrase_signature(r["next_text"])) for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([f for f in _STREAM if f.name in names]))

    closed = ends.select("doc_id", "text", "next_text").mapInArrow(close, _RESULT)
    return streamed.where("kind = 0").select(*names).unionByName(closed)
