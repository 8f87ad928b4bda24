"""Token ids as files, with an index that finds a document by its key in constant time.

Documents are sorted by key over ranges; each task encodes its range and writes shards: `NAME.ids` holds nothing but the ids, little-endian
unsigned, of 16 bits if the vocabulary fits them and else of 32, one document after the other, and `NAME.idx` finds them. The index is a minimal perfect hash of the shard's keys: levels of bit
arrays, where a key takes the bit it hits alone and goes one level down where it collides, so the count of set bits before its own numbers it
without gaps. Its slot holds the key's fingerprint (a bijection of its 64 bits, so no other key ever passes for it), the first of its
documents and their count; offsets of documents follow. A table of shards, a row each, says which keys and how many ids each holds.

Files are written under names of their own and renamed when complete; what they hold depends on the documents alone, so a task that runs again
replaces them with the same bytes. The folder must be on a store that pyarrow.fs opens (file, hdfs, s3, gs) and all executors see.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.tokens import encoder, tokenizer_path
from siltworks.llm.wordhash import mix
from siltworks.session import scratch, scratch_folder, ship_package

END_ID = 2
#: Documents and ids after which a shard is full; documents of a range, and ranges at most (more documents then make more shards of a range).
SHARD_DOCS, SHARD_IDS, RANGE_DOCS, MOST_RANGES = 1 << 20, 1 << 27, 8192, 20_000
#: Bits a level of the hash has for each of its keys, and levels at most; keys that no level parts (about one in 2**40) are searched by value.
BITS_PER_KEY, MOST_LEVELS = 2, 40

MAGIC = b"SILTIDX1"
_SHARD_FIELDS = "shard string, part int, roll int, n_docs long, n_null long, n_ids long, first_key long, last_key long"
_WORD = np.uint64(64)


def _hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ mix(np.full(1, level + 1, np.uint64)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """A bijection of the 64 bits of each key."""
    return mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: sizes of the levels in words, all their words, set bits before each word, and left-over keys."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left) and len(sizes) < MOST_LEVELS:
            n = -(-BITS_PER_KEY * len(left) // 64)
            bits = _hashed(left, len(sizes)) % (_WORD * np.uint64(n))
            hits = np.bincount(bits.astype(np.int64), minlength=64 * n)
            levels.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            sizes.append(n)
            left = left[hits[bits.astype(np.int64)] > 1]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return PerfectHash(np.array(sizes, np.int64), words, _ranks(words), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 without gaps; -1 or any number for keys that are not in."""
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, n in enumerate(self.sizes.tolist()):
            bits = _hashed(keys[open_], level) % (_WORD * np.uint64(n))
            at, bit = base + (bits >> np.uint64(6)).astype(np.int64), bits & np.uint64(63)
            word = self.words[at]
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = self.before[at[hit]] + below[hit]
            open_ = open_[~hit]
            base += n
        if len(self.rest) and len(open_):
            set_bits = int(self.before[-1]) + int(np.bitwise_count(self.words[-1:]).sum()) if len(self.words) else 0
            at = np.searchsorted(self.rest, keys[open_])
            there = (at < len(self.rest)) & (self.rest[np.minimum(at, len(self.rest) - 1)] == keys[open_])
            out[open_[there]] = set_bits + at[there]
        return out


def _ranks(words: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(words).astype(np.int64)
    return np.cumsum(counts) - counts


@dataclass
class ShardIndex:
    """The index of one shard: documents are numbered in order of their keys, null keys first."""

    width: int
    n_null: int
    hash: PerfectHash
    prints: np.ndarray
    first: np.ndarray
    count: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, n_null: int, lengths: np.ndarray, width: int = 4) -> ShardIndex:
        """keys: of the documents with one, ascending; lengths: ids of all documents; width: bytes of an id."""
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        distinct = keys[starts]
        found = PerfectHash.of(distinct)
        slots = found.slots(distinct)
        prints, first, count = np.empty(len(distinct), np.uint64), np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        prints[slots] = fingerprints(distinct)
        first[slots] = starts + n_null
        count[slots] = np.diff(np.concatenate((starts, [len(keys)])))
        return ShardIndex(width, n_null, found, prints, first, count, np.concatenate(([0], np.cumsum(lengths))))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first document of each key and how many it has; none for keys that the shard does not hold."""
        slot = self.hash.slots(keys)
        held = (slot >= 0) & (slot < len(self.prints))
        slot = np.where(held, slot, 0)
        if len(self.prints):
            held &= self.prints[slot] == fingerprints(keys)
            return np.where(held, self.first[slot], 0), np.where(held, self.count[slot], 0)
        return slot, np.zeros(len(keys), np.int64)

    def to_bytes(self) -> bytes:
        h = self.hash
        head = np.array([self.width, len(self.offsets) - 1, self.n_null, len(self.prints), len(h.sizes), len(h.words), len(h.rest)], "<i8")
        parts = [h.sizes.astype("<i8"), h.words.astype("<u8"), h.rest.astype("<i8"), self.prints.astype("<u8"), self.first.astype("<i8"), self.count.astype("<i8"), self.offsets.astype("<i8")]
        body = b"".join(p.tobytes() for p in (head, *parts))
        return MAGIC + body + zlib.crc32(body).to_bytes(8, "little")

    @staticmethod
    def from_bytes(raw: bytes) -> ShardIndex:
        body = raw[8:-8]
        if raw[:8] != MAGIC or zlib.crc32(body) != int.from_bytes(raw[-8:], "little"):
            raise ValueError("not an index of token ids, or a damaged one")
        width, n_docs, n_null, n_keys, n_levels, n_words, n_rest = np.frombuffer(body, "<i8", 7).tolist()
        out, at = [], 56
        for n, kind in ((n_levels, "<i8"), (n_words, "<u8"), (n_rest, "<i8"), (n_keys, "<u8"), (n_keys, "<i8"), (n_keys, "<i8"), (n_docs + 1, "<i8")):
            out.append(np.frombuffer(body, kind, n, at))
            at += 8 * n
        sizes, words, rest, prints, first, count, offsets = out
        return ShardIndex(width, n_null, PerfectHash(sizes, words, _ranks(words), rest), prints, first, count, offsets)


def id_width(ids: int) -> int:
    """Bytes of an id of a vocabulary of so many ids."""
    return 2 if ids <= 1 << 16 else 4


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; a path without a scheme is local."""
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


class _ShardWriter:
    """Writes one shard under names of its own; close() gives them their real ones."""

    def __init__(self, folder: str, name: str, width: int):
        self.width = width
        self.store, path = _store(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.temporary = posixpath.join(path, name), posixpath.join(path, f".{name}-{uuid.uuid4().hex}")
        self.ids = self.store.open_output_stream(f"{self.temporary}.ids")
        self.keys, self.lengths, self.n_null, self.n_ids = [], [], 0, 0

    def put(self, key: int | None, ids: bytes) -> None:
        self.ids.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        if key is None:
            self.n_null += 1
        else:
            self.keys.append(key)

    def full(self, docs: int, ids: int) -> bool:
        return len(self.lengths) >= docs or self.n_ids >= ids

    def close(self) -> tuple:
        self.ids.close()
        index = ShardIndex.of(np.array(self.keys, np.int64), self.n_null, np.array(self.lengths, np.int64), self.width)
        with self.store.open_output_stream(f"{self.temporary}.idx") as out:
            out.write(index.to_bytes())
        for kind in (".ids", ".idx"):
            self.store.move(self.temporary + kind, self.path + kind)
        return len(self.lengths), self.n_null, self.n_ids, self.keys[0] if self.keys else None, self.keys[-1] if self.keys else None


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, folder: str, name: str):
        store, path = _store(folder)
        with store.open_input_stream(posixpath.join(path, f"{name}.idx")) as f:
            self.index = ShardIndex.from_bytes(f.read())
        self.ids = store.open_input_file(posixpath.join(path, f"{name}.ids"))

    def document(self, number: int) -> bytes:
        """Ids of a document, little-endian 32-bit whatever the file's width."""
        start, end = self.index.offsets[number : number + 2].tolist()
        width = self.index.width
        raw = self.ids.read_at(width * (end - start), width * start)
        return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()

    def close(self) -> None:
        self.ids.close()


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, ranges: int | None = None, shard_docs: int = SHARD_DOCS, shard_ids: int = SHARD_IDS
) -> DataFrame:
    """Writes docs (doc_id, text) under folder and returns the table of shards: shard, part, roll, n_docs, n_null, n_ids, first_key, last_key.

    Documents are in ascending doc_id, null ones first; those of equal doc_id come by a hash of their texts. Null and empty texts are the end id
    alone. Texts are encoded whole, however long. Repeated rows are documents of their own. An empty table writes no shard. Other columns are ignored,
    whatever their names.
    """
    path = path or tokenizer_path()
    if ranges is None:
        ranges = max(1, min(MOST_RANGES, -(-docs.count() // RANGE_DOCS)))
    names = [c.split(" ")[0] for c in _SHARD_FIELDS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder, end = TaskContext.get().partitionId(), encoder(path), int(end_id).to_bytes(4, "little")
        width = id_width(max(coder.tokenizer.get_vocab_size(), end_id + 1))
        done: list[tuple] = []
        writer = None
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if writer is not None and writer.full(shard_docs, shard_ids):
                    done.append((part, len(done), *writer.close()))
                    writer = None
                if writer is None:
                    writer = _ShardWriter(folder, _name(part, len(done)), width)
                writer.put(key, coder.ids(text.as_py() or "") + end)
        if writer is not None:
            done.append((part, len(done), *writer.close()))
        columns = list(zip(*((_name(r[0], r[1]), *r) for r in done), strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ship_package(docs.sparkSession)
    # Rows of one key may be many: ties are parted by text and, where equal throughout, by chance.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.rand(11).alias("salt"))
    ordered = rows.repartitionByRange(ranges, "doc_id", "tie", "salt").sortWithinPartitions("doc_id", "tie")
    return scratch(ordered.select("doc_id", "text").mapInArrow(write, _SHARD_FIELDS), "shards")


def _name(part: int, roll: int) -> str:
    return f"part-{part:05d}-{roll:05d}"


@dataclass
class _Catalog:
    """Shards in order, for routing keys: a few numbers each. There is a shard per SHARD_DOCS documents or SHARD_IDS ids, and one per range at most
    beside, so 100 TB of ids make about 220,000 of them, 10 MB."""

    names: list[str]
    starts: np.ndarray
    nulls: np.ndarray
    firsts: np.ndarray
    lasts: np.ndarray
    keyed: np.ndarray

    @staticmethod
    def of(shards: DataFrame) -> _Catalog:
        rows = sorted(shards.collect(), key=lambda r: (r.part, r.roll))
        keyed = [i for i, r in enumerate(rows) if r.first_key is not None]
        counts = np.array([r.n_ids for r in rows], np.int64)
        return _Catalog(
            [r.shard for r in rows],
            np.cumsum(counts) - counts,
            np.array([i for i, r in enumerate(rows) if r.n_null], np.int64),
            np.array([rows[i].first_key for i in keyed], np.int64),
            np.array([rows[i].last_key for i in keyed], np.int64),
            np.array(keyed, np.int64),
        )

    def shards_of(self, key: int | None) -> Iterable[int]:
        if key is None:
            return self.nulls.tolist()
        low, high = np.searchsorted(self.lasts, key), np.searchsorted(self.firsts, key, side="right")
        return self.keyed[low:high].tolist()


def look_up(spark: SparkSession, keys: DataFrame, shards: DataFrame, folder: str, tasks: int | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document whose key is among keys (a column doc_id), read by key from the files.

    start counts the ids of all documents before. Keys may be null and may repeat; they are looked up once. A key that no document has gives no row;
    a key of many documents gives a row each.
    """
    catalog = _Catalog.of(shards)
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(key, s) for key in batch.column("doc_id").to_pylist() for s in catalog.shards_of(key)]
            columns = list(zip(*pairs, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32())], ["doc_id", "shard"])

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        fields.append(("ids", pa.binary()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))).tolist() if len(shard) else [0]
            for low, high in zip(edges, edges[1:], strict=False):
                if shard[low] != at:
                    if reader is not None:
                        reader.close()
                    at = int(shard[low])
                    reader = ShardReader(folder, catalog.names[at])
                yield from answer(reader, int(catalog.starts[at]), batch.column("doc_id").slice(low, high - low))
        if reader is not None:
            reader.close()

    def answer(reader: ShardReader, base: int, column: pa.Array) -> Iterator[pa.RecordBatch]:
        given = column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        first, count = reader.index.find(given)
        runs = list(zip(given.tolist(), first.tolist(), count.tolist(), strict=True))
        if column.null_count:
            runs.append((None, 0, reader.index.n_null))
        out: list[tuple] = []
        size = 0
        for key, low, n in runs:
            for number in range(low, low + n):
                ids = reader.document(number)
                row = (key, base + int(reader.index.offsets[number]), len(ids) // 4, zlib.crc32(ids))
                out.append((*row, ids) if with_ids else row)
                size += len(ids) if with_ids else 64
                if size > 8 << 20:
                    yield packed(out)
                    out, size = [], 0
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    ship_package(spark)
    routed = wanted.mapInArrow(route, "doc_id long, shard int")
    tasks = tasks or max(1, min(MOST_RANGES, len(catalog.names)))
    dealt = routed.repartitionByRange(tasks, "shard", "doc_id").sortWithinPartitions("shard", "doc_id")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def encoded_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID, ranges: int | None = None) -> DataFrame:
    """Writes docs as token files in the shared checkpoint folder and reads every document back by its key: doc_id, start, n_tokens, ids_crc32.
    Cases as in write_token_files; documents of a null doc_id come back with it."""
    folder = scratch_folder(docs.sparkSession, "tokens")
    shards = write_token_files(docs, folder, path, end_id, ranges)
    return look_up(docs.sparkSession, docs, shards, folder)
