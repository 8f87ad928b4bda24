import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from siltworks.llm import lengths, packing
from siltworks.llm.tokens import Encoder, tokenizer_path


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_tokenizer():
    coder = Encoder(tokenizer_path(), cache_words=50)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcDEF' \t\n.,!?09\x1c\x85\xa0ßÀé<|>"))))
    def same(text):
        assert coder.array(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|>", "a<|startoftext|>b", "we'LL DON'T", "x" * 500, "Σίσυφος ΣΑΣ", "\x1cA\x1dB"):
        assert coder.array(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_encode_whole_texts():
    coder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    assert Encoder(tokenizer_path()).by_pieces and not coder.by_pieces
    for text in ("Hello  World, it's 3 o'clock", " a  b\n\nc", "日本語 ß"):
        assert coder.array(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(odd_docs):
    coder = Encoder(tokenizer_path())
    rows = packing.pack_documents(odd_docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = defaultdict(int)
    total = 0
    for doc, text in texts:
        ids = plain_ids(coder.tokenizer, text)
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert got == want
    assert check_sequences(rows, 2048) <= -(-total // 2048) + 2


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs).collect() == []
    assert lengths.token_lengths(no_docs).collect() == []


def test_online_packing_is_close_to_the_bound():
    r = random.Random(3)
    sizes = [min(2048, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(20000)]
    bound = -(-sum(sizes) // 2048)
    used = {}
    for open_bins in (1, 8, 64, packing.OPEN_BINS):
        packer = packing.BestFit(2048, open_bins)
        rows = []
        for n in sizes:
            home, offset = packer.put(n)
            rows.append({"sequence_id": home, "offset": offset, "length": n})
            assert packer.open == sum(map(len, packer.stacks)) <= open_bins
        used[open_bins] = check_sequences(rows, 2048)
    assert used[1] > used[8] > used[64] >= used[packing.OPEN_BINS]
    assert used[packing.OPEN_BINS] <= 1.01 * bound


def test_packers_stream_side_by_side(spark, no_docs):
    r = random.Random(4)
    rows = [(i % 50 or None, i, 0, r.randint(1, 2048), r.getrandbits(32), "x") for i in range(5000)]
    pieces = spark.createDataFrame(rows, packing.PIECE_SCHEMA + ", offset string")
    out = packing.place(pieces, packers=7).collect()
    assert sorted((x["length"], x["ids_crc32"]) for x in out) == sorted((x[3], x[4]) for x in rows)
    assert check_sequences(out, 2048) <= 1.1 * sum(x[3] for x in rows) / 2048


def test_fullest_bin_closes_first():
    packer = packing.BestFit(10, 2)
    assert packer.put(6) == (0, 0)
    assert packer.put(9) == (1, 0)
    assert packer.put(8) == (2, 0)  # bin 1 was the fullest and is closed
    assert packer.put(1)[0] == 2
    assert packer.put(4) == (0, 6)


def test_token_lengths(spark, odd_docs):
    coder = Encoder(tokenizer_path())
    sizes = [len(plain_ids(coder.tokenizer, r["text"])) - 1 for r in odd_docs.collect()]
    rows = {r["n_tokens"]: r for r in lengths.token_lengths(odd_docs).collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == {n: sizes.count(n) for n in set(sizes)}
    for limit, r in rows.items():
        assert r["truncated_total"] == sum(min(n, limit) for n in sizes)
        assert r["docs_at_least"] == sum(n >= limit for n in sizes)
        assert r["tokens_total"] == sum(sizes)
    sums = lengths.token_lengths(odd_docs)
    limits = [1, 7, 100, 5000]
    got = {r[0]: r[1] for r in lengths.truncated_totals(sums, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect()}
    assert got == {x: sum(min(n, x) for n in sizes) for x in limits}
    half = lengths.quantiles(sums, [0.5]).first()["n_tokens"]
    assert half == sorted(sizes)[-(-len(sizes) // 2) - 1]


def test_truncated_totals_above_the_longest(spark):
    sums = lengths.suffix_sums(spark.createDataFrame([(0, 1), (3, 2), (10, 1)], "n_tokens long, n_docs long"))
    limits = spark.createDataFrame([(2,), (10,), (11,), (10**12,), (None,)], "context_limit long")
    assert {r[0]: r[1] for r in lengths.truncated_totals(sums, limits).collect()} == {2: 6, 10: 16, 11: 16, 10**12: 16, None: None}
    assert lengths.truncated_totals(sums.limit(0), limits.where("context_limit = 2")).first()[1] == 0
