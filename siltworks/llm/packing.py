"""Best-fit packing of documents into sequences of bounded length.

Documents are tokenised where they are scanned; only one small row per piece moves on. Pieces are dealt over packers at random. A packer streams
its pieces past a bounded number of open bins, found by a bitset keyed by free space: a piece goes to the open bin with the least free space that
holds it; when too many are open the fullest closes. No bin is opened again and nothing is packed twice. Pieces come in the order of their
checksums: in random order a few hundred open bins hold nearly as well as any number of them (see the figures in the README), while by length
the bound would close bins long before the short pieces that fit them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltworks.llm.tokens import encoder, tokenizer_path
from siltworks.session import scratch, ship_package

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Open bins of a packer.
OPEN_BINS = 128
#: Pieces of one packer, and packers at most (they take more pieces beyond that: a packer's memory is its open bins).
PIECES_PER_PACKER, MOST_PACKERS = 250_000, 20_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}


class BestFit:
    """Online best fit over a fixed number of open bins.

    stacks[f] holds the open bins with f free tokens; bit f of bits is set while that stack is not empty.
    """

    def __init__(self, capacity: int, open_bins: int, first_bin: int = 0):
        self.capacity, self.open_bins, self.next_bin = capacity, open_bins, first_bin
        self.bits, self.open = 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            stack = self.stacks[free]
            home = stack.pop()
            if not stack:
                self.bits ^= 1 << free
        else:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.stacks[fullest].pop()
                if not self.stacks[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            free, home = self.capacity, self.next_bin
            self.next_bin += 1
            self.open += 1
        left = free - length
        if left:
            self.stacks[left].append(home)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return home, self.capacity - free


def cut_pieces(docs: DataFrame, path: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and end_id, cut only where longer than capacity."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = coder.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [()] * len(PIECE_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES.values(), strict=True)], list(PIECE_TYPES))

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA)


def place(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, packers: int = 1) -> DataFrame:
    """Adds sequence_id and offset to rows of (length, ids_crc32, doc_id, piece, ...). packers tasks work side by side, each on its own
    sequences; rows are dealt round robin, never by a key."""
    names = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes if n in names) + ", sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = BestFit(capacity, open_bins)
        base = np.int64(TaskContext.get().partitionId()) << 40
        for batch in batches:
            placed = np.array([packer.put(n) for n in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + placed[:, 0]), pa.array(placed[:, 1])], [*names, "sequence_id", "offset"])

    ordered = pieces.select(*names).repartition(packers).sortWithinPartitions("ids_crc32", "doc_id", "piece")
    return ordered.mapInArrow(pack, schema)


def pack_documents(
    docs: DataFrame, path: str | None = None, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID
) -> DataFrame:
    """One row per piece with its sequence and place.

    Null and empty texts are a document of the end id alone. A null doc_id stays null. Repeated rows and rows of equal doc_id are packed as often as
    they come. Of bins with equal free space the last one used is taken. A text is tokenised whole, however long, and only cut at
    capacity. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    pieces = scratch(cut_pieces(docs, path or tokenizer_path(), capacity, end_id), "pieces")
    packers = min(MOST_PACKERS, max(1, -(-pieces.count() // PIECES_PER_PACKER)))
    return place(pieces, capacity, open_bins, packers)
