"""Token files: exact round trips, the index, and keyed access."""

import os
import zlib

import numpy as np
import pytest
from siltworks.llm import tokenfiles
from siltworks.llm.tokenfiles import PerfectHash, ShardIndex, ShardReader
from siltworks.llm.tokens import tokenizer_path
from siltworks.session import scratch_folder

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, docs):
    """[(doc_id, start, n_tokens, crc)] of (doc_id, text) pairs, by the tokenizer itself; documents of one id as a set of their lengths and sums."""
    start, out = 0, []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(frame):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in frame.collect()), key=lambda r: r[1])


def test_table_round_trip(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = expected(tokenizer, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert rows_of(tokenfiles.encoded_and_read(docs.repartition(5), ranges=3)) == want


def test_odd_documents(spark, tokenizer, odd_docs):
    pairs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = rows_of(tokenfiles.encoded_and_read(odd_docs, ranges=4))
    want = expected(tokenizer, pairs)
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and got[0][1] == 0


def test_no_documents(spark, no_docs):
    assert tokenfiles.encoded_and_read(no_docs).collect() == []


def test_one_key_of_half_the_rows_over_many_shards(spark, tokenizer):
    pairs = [(5 if i % 2 else i, f"text number {i % 7}") for i in range(300)] + [(None, f"none {i}") for i in range(50)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    folder = scratch_folder(spark, "tokens")
    shards = tokenfiles.write_token_files(docs, folder, ranges=6, shard_docs=20)
    made = shards.collect()
    assert len(made) > 12 and max(r.n_docs for r in made) <= 20 and sum(r.n_docs for r in made) == 350
    got = rows_of(tokenfiles.look_up(spark, docs, shards, folder, tasks=4))
    assert [r[0] for r in got] == [r[0] for r in expected(tokenizer, pairs)] and len({r[1] for r in got}) == 350


def test_only_wanted_keys_with_their_ids(spark, tokenizer):
    pairs = [(i * 3, f"word {i} and more") for i in range(200)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    folder = scratch_folder(spark, "tokens")
    shards = tokenfiles.write_token_files(docs, folder, ranges=3, shard_docs=30)
    keys = spark.createDataFrame([(k,) for k in (0, 3, 3, 4, 300, 597, 600, -1, None)], "doc_id long")
    got = {r.doc_id: r for r in tokenfiles.look_up(spark, keys, shards, folder, with_ids=True).collect()}
    assert set(got) == {0, 3, 300, 597}
    for key, row in got.items():
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == [*tokenizer.encode(f"word {key // 3} and more", add_special_tokens=False).ids, 2] and row.n_tokens == len(ids)


def test_wide_ids(spark, tokenizer):
    pairs = [(i, f"document {i}") for i in range(40)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    folder = scratch_folder(spark, "tokens")
    shards = tokenfiles.write_token_files(docs, folder, end_id=70_000, ranges=2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfiles.look_up(spark, docs, shards, folder, with_ids=True).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 70_000] for i, t in pairs}
    assert tokenfiles.id_width(1 << 16) == 2 and tokenfiles.id_width((1 << 16) + 1) == 4


def test_files_hold_ids_and_nothing_else(spark, tokenizer):
    pairs = [(i, f"document {i}") for i in range(40)]
    folder = scratch_folder(spark, "tokens")
    shards = tokenfiles.write_token_files(spark.createDataFrame(pairs, "doc_id long, text string"), folder, ranges=2)
    path = folder.removeprefix("file://")
    names = sorted(os.listdir(path))
    assert names == sorted(r.shard + kind for r in shards.collect() for kind in (".ids", ".idx"))
    raw = b"".join(open(os.path.join(path, n), "rb").read() for n in names if n.endswith(".ids"))
    whole = [i for _, t in pairs for i in [*tokenizer.encode(t, add_special_tokens=False).ids, 2]]
    assert np.frombuffer(raw, "<u2").tolist() == whole  # the vocabulary has fewer than 65,536 ids
    reader = ShardReader(folder, names[0].split(".")[0])
    first, count = reader.index.find(np.array([0, 10**9]))
    assert count.tolist() == [1, 0] and np.frombuffer(reader.document(int(first[0])), "<u4").tolist() == whole[: len(whole[: whole.index(2) + 1])]
    reader.close()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 100_000])
def test_hash_is_perfect_and_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    found = PerfectHash.of(keys)
    assert np.array_equal(np.sort(found.slots(keys)), np.arange(len(keys)))
    if n > 1000:
        assert 64 * len(found.words) < 5 * n


def test_keys_that_no_level_parts(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MOST_LEVELS", 1)
    keys = np.arange(1000)
    found = PerfectHash.of(keys)
    assert len(found.rest) and np.array_equal(np.sort(found.slots(keys)), np.arange(1000))
    index = ShardIndex.of(keys, 3, np.ones(1003, np.int64))
    first, count = index.find(np.array([999, 0, 1000, -5]))
    assert first[:2].tolist() == [1002, 3] and count.tolist() == [1, 1, 0, 0]


def test_index_survives_its_bytes_and_damage_shows():
    keys = np.array([2, 2, 5, 9, 9, 9])
    index = ShardIndex.of(keys, 1, np.array([4, 1, 2, 3, 4, 5, 6]))
    again = ShardIndex.from_bytes(index.to_bytes())
    for x in (index, again):
        first, count = x.find(np.array([9, 2, 5, 7, -1]))
        assert first[:3].tolist() == [4, 1, 3] and count.tolist() == [3, 2, 1, 0, 0]
        assert x.offsets.tolist() == [0, 4, 5, 7, 10, 14, 19, 25]
    raw = bytearray(index.to_bytes())
    raw[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        ShardIndex.from_bytes(bytes(raw))
    assert ShardIndex.of(np.zeros(0, np.int64), 2, np.array([1, 1])).find(np.array([1]))[1].tolist() == [0]
