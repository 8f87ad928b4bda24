import hashlib

import brute
import pytest
from pyspark.sql import functions as F
from siltworks.llm import neardup, passages
from siltworks.operators import links as components


def near(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}


def test_near_duplicates_match_all_pairs(corpus, corpus_docs):
    want = {d: (n, c, c == d) for d, (n, c) in brute.near_components(corpus).items()}
    assert near(corpus_docs) == want
    assert len({c for _, c, _ in want.values()}) < len(want) - 10


@pytest.mark.parametrize("few", [0, 2])
def test_crowded_buckets_lose_no_link(corpus, corpus_docs, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    assert near(corpus_docs) == {d: (n, c, c == d) for d, (n, c) in brute.near_components(corpus).items()}


def test_families_around_a_common_passage(spark, monkeypatch):
    """Texts that share most of their words with all others, at similarities on both sides of the limit, and chains that only cross links join."""
    import random

    r = random.Random(2)
    body = [f"b{i}" for i in range(120)]
    docs = []
    for k in range(160):
        own = [f"k{k % 70}x{i}" for i in range(r.choice((13, 15, 16, 17, 18, 20, 24, 40)))]
        docs.append(" ".join((body + own) if k % 2 else (body[: r.randint(100, 120)] + own)))
    chain = [f"c{i}" for i in range(300)]
    docs += [" ".join(chain[9 * k : 9 * k + 110]) for k in range(20)]
    corpus = list(enumerate(docs, 1))
    want = {d: (n, c, c == d) for d, (n, c) in brute.near_components(corpus).items()}
    table = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    assert 15 < len({c for _, c, _ in want.values()}) < 150
    for few in (0, 4, 32):
        monkeypatch.setattr(neardup, "FEW", few)
        assert near(table) == want


def test_first_shingles_meet_for_every_similar_pair(spark, corpus, corpus_docs):
    """The prefix rule over all pairs of the corpus, against their sets."""
    sets = {d: brute.shingles(t) for d, t in corpus}
    classes = {d for d, s in sets.items() if s}
    reps = spark.createDataFrame([(d,) for d in classes], "rep long")
    rows = neardup._first_shingles(reps, neardup._Sets(corpus_docs)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["bucket"], []).append((r["rep"], r["n"], r["most"]))
    met = {(x, y) for group in by.values() for x, n, top in group for y, m, most in group if n <= most and m <= top and x != y}
    for x in classes:
        for y in classes:
            if x != y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                assert (x, y) in met


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[8]["component_id"] == 7 and not by[8]["kept"]
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0 and by[4]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert neardup.near_duplicates(no_docs).collect() == []
    kept = neardup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(by) - {2, 3, 8, 15}


def test_bayes_bounds_keep_similar_pairs():
    assert (neardup.LEAST[1:] >= neardup.LEAST[:-1]).all()
    assert neardup.LEAST[-1] < 0.8 * neardup.HASHES


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 130)]
    links = spark.createDataFrame(path + star + [(200, 200), (300, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 130))
    assert got[200] == 200 and got[300] == 300


def removed(docs):
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.repeated_passages(docs).collect())


def test_repeated_passages_match_brute_force(corpus, corpus_docs, monkeypatch):
    want = sorted((d, n, c, hashlib.sha256(k.encode()).hexdigest()) for d, n, c, k in brute.repeated_passages(corpus))
    assert sum(c for _, _, c, _ in want) > 3000
    assert removed(corpus_docs) == want
    monkeypatch.setattr(passages, "DOCS_PER_GROUP", 13)
    monkeypatch.setattr(passages, "CHUNK", 7)
    assert removed(corpus_docs) == want


def test_only_documents_that_share_an_anchor_hold_recurring_windows(corpus, corpus_docs):
    """What step 4 leaves out: no word of a document without a shared anchor is in a recurring window."""
    suspects = {r["doc_id"] for r in passages.suspects_of(passages.survey(corpus_docs)).collect()}
    losing = {d for d, _, c, _ in brute.repeated_passages(corpus) if c}
    assert losing and losing <= suspects < {d for d, _ in corpus}


def test_a_common_passage_is_no_single_row(spark, monkeypatch):
    """A passage that every document holds goes to each group as a row of its own, once."""
    monkeypatch.setattr(passages, "DOCS_PER_GROUP", 5)
    passage = " ".join(f"p{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"a{i} b{i} " + passage + f" c{i}") for i in range(100)], "doc_id long, text string")
    texts = docs.join(passages.suspects_of(passages.survey(docs)), "doc_id")
    rows = passages.located_passages(texts, passages.groups_for(100)).collect()
    assert len({r["group"] for r in rows}) > 10 and {r["home"] for r in rows} == {0}
    assert len(rows) == len({(r["group"], r["passage"]) for r in rows}) and max(len(r["passage"].split()) for r in rows) <= passages.CHUNK + 49
    got = removed(docs)
    assert [c for _, _, c, _ in got] == [0] + [200] * 99


def test_passages_odd_rows(odd_docs, no_docs):
    rows = passages.repeated_passages(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == 400 and by[3]["n_removed"] == 400 and by[15]["n_removed"] == 400
    assert by[4]["n_words"] == 0 and by[None]["n_removed"] == 0
    assert passages.repeated_passages(no_docs).collect() == []


def test_cut_documents(spark, odd_docs, corpus, corpus_docs):
    cut = passages.cut_documents(odd_docs)
    assert cut.columns == odd_docs.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert 2 not in rows and rows[3]["text"] == "tail" and rows[3]["n_chars"] == 4 and rows[15]["text"].split()[-1] == "p59"
    kept = {d: k for d, n, c, k in brute.repeated_passages(corpus) if c < n or n == 0}
    got = {r["doc_id"]: r["text"] for r in passages.cut_documents(corpus_docs).collect()}
    assert {d: " ".join(brute.words(t)) for d, t in got.items()} == kept


def test_automaton_alone():
    a = passages.PassageAutomaton(50)
    words = [b"w%d" % i for i in range(120)]
    a.add(1, b" ".join(words[:90]))
    a.compile()
    cover = a.covered(2, [b"x", *words[10:70], b"y", *words[80:130]])
    assert cover.sum() == 60 and not cover[0]
    assert not a.covered(1, words).any()


def test_checkpoint_folder_is_used(spark, corpus_docs):
    from siltworks.session import checkpoint_root, scratch

    assert scratch(spark.range(3)).agg(F.sum("id")).first()[0] == 3
    assert checkpoint_root(spark)
